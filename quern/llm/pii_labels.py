"""The small labelled table from which the tagger of personal data is trained, made by rule.

Every row is a short passage with the spans of personal data marked. Spans are composed in the forms in which people write
them, openly or so as to hide them. Names, streets, places and brands are mostly invented syllable by syllable with the
endings of their kind, and most ordinary words are invented, too, with the endings of nouns, adjectives and verbs: what the
tagger can learn from them is shape, ending and context, not a vocabulary. Ordinary passages hold the numbers, places, brands
and document titles that are not personal data. ``ROWS`` bounds the table.
"""

from __future__ import annotations

import random

#: Rows of the labelled table.
ROWS = 12000
SEED = 11

# Given names, stems of patronymics, digits in words, transliteration, months.
MEN = "Александр Алексей Анатолий Андрей Антон Аркадий Арсений Артём Артур Богдан Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Глеб Григорий Давид Даниил Денис Дмитрий Евгений Егор Захар Иван Игнат Игорь Илья Кирилл Константин Лев Леонид Максим Марат Марк Матвей Михаил Назар Никита Николай Олег Павел Пётр Прохор Роман Ринат Руслан Семён Сергей Станислав Степан Тимофей Тимур Фёдор Эдуард Юрий Яков Ярослав".split()
WOMEN = "Алина Алла Анастасия Анна Валентина Валерия Варвара Вера Вероника Виктория Галина Дарья Диана Ева Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инга Инна Ирина Карина Кира Кристина Ксения Лариса Лидия Любовь Людмила Майя Маргарита Марина Мария Надежда Наталья Нина Оксана Олеся Ольга Полина Раиса Светлана София Таисия Тамара Татьяна Ульяна Юлия Яна".split()
FATHERS = "Александров Алексеев Анатольев Андреев Антонов Борисов Вадимов Валерьев Васильев Викторов Владимиров Геннадьев Григорьев Денисов Дмитриев Евгеньев Егоров Иванов Игорев Кириллов Константинов Леонидов Максимов Михайлов Николаев Олегов Павлов Петров Романов Сергеев Степанов Фёдоров Юрьев".split()
DIGITS = ("ноль", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять")
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
KINDS = ("O", "email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS[1:] for p in "BI"))
_SMALL = "в на и с по для от до за без или у к мы вы наш ваша это уже всё ещё не если когда также очень только можно есть после перед под через каждый".split()
_ENDINGS = {
    "noun": "ка ки ку кой ение ения ость ник ников щик тор а ы у ом ами ов ях ие ия ции цию ство".split(),
    "adj": "ный ная ные ного ную ских ской ые ый ой".split(),
    "verb": "ает ают им ем уем ую ать ить ил или яем ишь ите йте".split(),
    "adverb": "но ски о ее".split(),
}
_UNITS = "рублей руб минут часов дней лет метров м см мм кг процентов % человек заявок отзывов соток этажей комнат шт".split()

Span = tuple[str, str]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    # invented words

    def syllables(self, n: int) -> str:
        return "".join(self.r.choice("бвгджзклмнпрстфхчш") + self.r.choice("аеиоуяы") for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def latin(self, text: str) -> str:
        return "".join(LATIN.get(c, LATIN[c.lower()].capitalize() if c.lower() in LATIN else c) for c in text)

    def word(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice(_SMALL)
        stem = self.syllables(r.randint(1, 3)) + r.choice(("", "р", "т", "л", "н", "ст", "к"))
        return stem + r.choice(_ENDINGS[r.choice(("noun", "noun", "adj", "verb", "adverb"))])

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def place(self) -> str:
        return self.syllables(self.r.randint(1, 3)).capitalize() + self.r.choice(("град", "ск", "инск", "овка", "ово", "ино", "поль", "горск", "лесье", "озеро", "бор", "речье", "дар", "мерье", "бург", "ославль", "тау", "холмы", "горье", "бережск"))

    def brand(self) -> str:
        r = self.r
        b = self.syllables(r.randint(1, 3)).capitalize() + r.choice(("кс", "лин", "рон", "тек", "вин", "дот", "мед", "сер", "нов", "фарм", "лаб", "строй", "нум", "рол", "гин", "лев", "ва", "ма", "н", "м", ""))
        b = self.latin(b) if r.random() < 0.5 else b
        return b.upper() if r.random() < 0.06 else b

    # personal data

    def phone(self) -> str:
        r = self.r
        a, b, c, d = self.digits(3), self.digits(3), self.digits(2), self.digits(2)
        head = r.choice(("8", "+7", "8", "+7", "7"))
        form = r.randrange(19)
        if form == 0:
            return f"{head} {a} {b} {c} {d}"
        if form == 1:
            return f"{head} ({a}) {b}-{c}-{d}"
        if form == 2:
            return f"{head} ({a}) {b}{c}{d}"
        if form in (3, 4, 16):
            return f"{r.choice(('8', '+7', '7', '8'))}{a}{b}{c}{d}"
        if form == 5:
            return f"{head}-{a}-{b}-{c}-{d}"
        if form == 6:
            return f"{head}.{a}.{b}.{c}.{d}"
        if form == 7:
            return " ".join(head.replace("+", "") + a + b + c + d)
        if form == 8:
            return f"{head}-{a}-{b}-{c}{d}".replace("0", r.choice("ОOоo"))
        if form in (9, 10):
            return f"{head} {a} {b} {DIGITS[int(c[0])]} {DIGITS[int(c[1])]} {d}"
        if form == 11:
            k = r.randint(1, 3)
            return " ".join(["восемь", *(DIGITS[int(x)] for x in a[:k]), (a + b + c + d)[k:]])
        if form == 12:
            return f"+{r.choice(('375', '999', '380', '998', '44', '49', '1'))} {self.digits(2)} {self.digits(3)} {self.digits(4)}"
        if form == 13:
            return " ".join(DIGITS[int(x)] for x in "8" + a + b + c + d)
        if form == 14:
            return f"{a}-{c}-{d}" if r.random() < 0.5 else f"{r.randint(2, 9)}-{c}-{d}"
        if form == 15:
            return f"9{a[:2]}{b}{c}{d}" if r.random() < 0.5 else f"{a} {b}-{c}-{d}"
        return f"{head} {a} {b}-{c}-{d}"

    def email(self) -> str:
        r = self.r
        tail = r.choice(("", "", ".dom", "_master", "-dom", "master", f"-{self.digits(2)}", f".{self.digits(1)}", self.digits(2), "+zakaz", f"_{self.digits(2)}", f".{self.latin(self.syllables(2))}"))
        user = self.latin(self.syllables(r.randint(1, 3))) + tail
        if r.random() < 0.15:
            user = user + r.choice(("+zakaz", "+info", "+shop"))
        host = r.choice(("", "", "mx.", "mail.")) + self.latin(self.syllables(r.randint(2, 4))) + r.choice(("", "-post", "mail", "-mail"))
        end = r.choice(("test", "example", "invalid", "ru", "com", "net", "org"))
        form = r.randrange(9)
        if form == 0:
            text = f"{user} @ {host}.{end}"
        elif form == 1:
            text = f"{user}(at){host}.{end}"
        elif form == 2:
            text = f"{user}[собака]{host}.{end}"
        elif form == 3:
            text = f"{user} собака {host} точка {end}"
        elif form == 4:
            text = f"{user} {r.choice(('at', '[at]', '(собака)'))} {host} {r.choice(('dot', 'точка', '(точка)'))} {end}"
        else:
            text = f"{user}@{host}.{end}"
        return text.upper() if r.random() < 0.12 else text

    def id_number(self) -> str:
        r, d = self.r, self.digits
        forms = (
            f"паспорт {d(2)} {d(2)} {d(6)}", f"паспорт серия {d(4)} № {d(6)}", f"паспорт: {d(10)}", f"паспорт {d(4)} {d(6)}", f"паспорт серии {d(4)} номер {d(6)}", f"паспорт РФ {d(4)} {d(6)}",
            f"ИНН {d(12)}", f"ИНН:{d(12)}", f"ИНН {d(10)}", f"СНИЛС {d(3)}-{d(3)}-{d(3)} {d(2)}", f"СНИЛС {d(11)}", f"СНИЛС: {d(3)} {d(3)} {d(3)} {d(2)}", f"страховой номер {d(9)}-{d(2)}", f"страховой номер {d(3)}-{d(3)}-{d(3)} {d(2)}",
            f"водительское удостоверение {d(2)} {d(2)} {d(6)}", f"водительское удостоверение {d(10)}", f"права {d(2)} {d(2)} {d(6)}", f"ВУ {d(4)} {d(6)}", f"ОГРНИП {d(15)}", f"ОГРНИП: {d(15)}", f"ОГРН {d(13)}", f"полис ОМС {d(16)}", f"полис {d(4)} {d(4)} {d(4)} {d(4)}", f"инн {' '.join(d(12))}",
        )
        text = r.choice(forms)
        return text.capitalize() if r.random() < 0.08 and text[0].islower() else text

    def street(self) -> str:
        r = self.r
        if r.random() < 0.75:
            return self.syllables(r.randint(2, 3)).capitalize() + r.choice(("ская", "ова", "рова", "нова", "цкая", "нина", "ная", "ная", "тая", "вая", "лая", "шая", "няя", "ёжная", "чная"))
        return r.choice(("Мира", "Победы", "Свободы", "Труда", "Космонавтов", "Строителей", "Первомайская", "Новая", "Школьная", "Парковая", "Молодёжная", "Октябрьская", "Советская", "Речная"))

    def address(self) -> str:
        r = self.r
        s, n, m = self.street(), r.randint(1, 150), r.randint(1, 300)
        two = self.syllables(2).capitalize()
        forms = (
            f"ул. {s}, д. {n}, кв. {m}", f"улица {s}, дом {n}", f"ул. {s}, {n}", f"{s} ул., {n}", f"ул {s} д {n} кв {m}", f"{s} улица, {n}", f"{s} улица {n}", f"улица {s} {n}", f"ул.{s} {n}",
            f"пр-т {two}цев, {n}, офис {m}", f"проспект {s}, {n}", f"пер. {s[:-2]}ый, стр. {n}", f"переулок {s}, дом {n}", f"мкр. {two}{r.choice(('са', 'му', 'ра', 'н', ''))}, д.{n}, подъезд {r.randint(1, 9)}", f"пер. {s[:-2]}ый, {n}",
            f"наб. реки {two}, {n}/{r.randint(1, 9)}", f"бульвар {s}, {n}", f"ш. {s}, д. {n}", f"{s} улица {n} квартира {m}", f"{s} улица {n} квартира {m}", f"микрорайон {two}, дом {n}", f"наб. реки {r.choice(WOMEN)}, {n}/{r.randint(1, 9)}",
            f"ул {s} {n}к{r.randint(1, 9)}", f"{n} {self.latin(s)} Street, apt {m}", f"{n} {self.latin(s)} Street", f"{self.latin(s)} st., {n}", f"ul. {self.latin(s)}, d. {n}, kv. {m}", f"пр-д {s}, д. {n}к{r.randint(1, 4)}", f"пл. {s}, {n}", f"{two}{r.choice(('вский', 'ский', 'ный'))} {r.choice(('проспект', 'переулок', 'бульвар', 'проезд', 'пр-т'))}, {n}", f"тупик {s}, {n}а", f"шоссе {s}, {n}, стр. {r.randint(1, 9)}",
        )
        text = r.choice(forms)
        if "квартира" in text and r.random() < 0.7 or r.random() < 0.05:
            text = text.lower()
        return text

    def person(self) -> str:
        r = self.r
        woman = r.random() < 0.5
        # Some given names are invented, so that surnames, patronymics and the context have to do; hardly any where case is no help.
        how = r.random()
        given = r.choice(WOMEN if woman else MEN) if r.random() < (0.95 if how < 0.4 else 0.65) else self.syllables(r.randint(1, 3)).capitalize() + (r.choice(("на", "ра", "ия", "ля", "ида", "иля")) if woman else r.choice(("р", "н", "д", "м", "ат", "ур", "ил", "ек", "ид")))
        stem = r.choice(FATHERS) if r.random() < 0.8 else self.syllables(2).capitalize() + r.choice(("ов", "ев"))
        middle = stem + ("на" if woman else "ич")
        root = self.syllables(r.randint(1, 3)).capitalize()
        last = root + r.choice((("нова", "рова", "лева", "нина", "ская", "ренко", "венко", "мова", "кина", "цкая", "дзе", "ян", "чук", "баева", "ман", "штейн", "берг", "ник", "ец", "ко") if woman else ("нов", "ров", "лев", "нин", "ский", "ренко", "венко", "мов", "кин", "цкий", "дзе", "ян", "чук", "швили", "баев", "ман", "штейн", "берг", "ник", "ец", "ко")))
        i, j = given[0], middle[0]
        forms = (f"{given} {middle} {last}", f"{given} {middle} {last}", f"{last} {given} {middle}", f"{given} {middle}", f"{given} {last}", f"{last} {given}", f"{last} {i}. {j}.", f"{last} {i}. {j}.", f"{i}. {j}. {last}", f"{i}.{j}. {last}", f"{last} {i}.{j}.", f"{given} {middle}", f"{given} {last}", f"{last} {given}")
        text = r.choice(forms)
        if how < 0.24:
            return text.lower() if "." not in text else text
        if how < 0.42:
            return text.upper()
        if how < 0.6 and "." not in text:
            return self.latin(text)
        return text

    def span(self, kind: str) -> Span:
        return {"email": self.email, "phone": self.phone, "id_number": self.id_number, "address": self.address, "person_name": self.person}[kind](), kind

    # passages

    def invented(self) -> str:
        """A sentence of invented words, now and then with a number, a place or a brand in it."""
        r = self.r
        parts = [self.words(2, 5)]
        for _ in range(r.randint(0, 2)):
            parts.append(r.choice((
                f"{r.choice(('', 'от ', 'до ', 'за ', 'около '))}{r.choice((r.randint(1, 99), r.randint(100, 999), f'{r.randint(1, 99)}00', f'{r.randint(1, 99)} {r.randint(100, 999)}', f'{r.randint(1, 200)}00'))} {r.choice(_UNITS)}",
                f"{r.choice(('в', 'из', 'под', 'посёлок', 'город', 'г.'))} {self.place()}", f"{self.place()} и {self.place()}", f"{r.choice(('', 'фирмы ', 'бренд ', 'бригада ', 'магазин ', 'для '))}{self.brand()}", f"{r.randint(1, 30)} {r.choice(MONTHS)}", self.words(2, 4), self.words(1, 3) + ",",
            )))
        if r.random() < 0.6:
            parts.append(self.words(1, 4))
        text = " ".join(parts)
        return text[0].upper() + text[1:]

    def service(self) -> str:
        """A title: what is done to what, of invented and common words, with or without a brand."""
        r = self.r
        if r.random() < 0.4:
            deed = r.choice("Покраска Заточка Чистка Пошив Сборка Вывоз Ремонт Установка Стрижка Доставка Прокат Аренда Обрезка Кладка Уборка Монтаж Замена Настройка Спил Мойка Перевозка Обивка Укладка Реставрация".split())
        else:
            deed = (self.syllables(r.randint(1, 3)) + r.choice(("ка", "ние", "ение", "ж", "л", "т", "вка", "ия"))).capitalize()
        if r.random() < 0.3:
            thing = r.choice("заборов ножей ковров штор шкафов мусора велосипедов дверей кошек цветов лодок домов кустов печей офисов колодцев насосов часов зонтов диванов роялей котлов кранов теплиц замков ворот колёс балконов чехлов обоев ульев".split())
        else:
            thing = self.syllables(r.randint(1, 3)) + r.choice(("ов", "ров", "нов", "тов", "ков", "ев", "ьев", "ей", "ний", "в", "ниц", "к", "шин", "ных", "ских", "ы"))
        if r.random() < 0.25:
            thing = self.syllables(2) + r.choice(("ных", "ских", "льных", "вых", "ого", "ной")) + " " + thing
        if r.random() < 0.25:
            # A trade in one word.
            deed = r.choice("Грузчики Видеосъёмка Автосервис Клининг Эвакуатор Озеленение Шиномонтаж Металлоремонт Ателье Химчистка Массаж Ветеринар Парикмахер Автоперевозки Пассажироперевозки Аэросъёмка".split()) if r.random() < 0.4 else (self.syllables(r.randint(2, 4)) + r.choice(("ки", "ка", "инг", "ёмка", "возки", "ция"))).capitalize()
            return f"{deed} {r.choice((self.brand(), self.brand(), self.place(), self.words(1, 3)))}"
        tail = r.choice(("", "", f" {self.brand()}", f" {self.brand()}", f" {self.place()}", " на дому", " недорого", " срочно", f", {self.words(2, 4)}", f" {self.word()}"))
        return f"{deed} {thing}{tail}"

    def plain(self) -> str:
        r, n, d = self.r, self.r.randint, self.digits
        p, b, w = self.place, self.brand, self.word
        kind = r.random()
        if kind < 0.42:
            text = self.invented()
        elif kind < 0.62:
            text = self.service()
        else:
            forms = (
                f"Везём товар по маршруту {p()} — {p()}", f"Дорога до {p()} отнимает {n(5, 90)} минут", f"Закрыли объект {n(1, 30)} {r.choice(MONTHS)}, акт подписан", f"Разбираемся в {b()} и {b()} не хуже завода", f"В команде {b()} сейчас {n(5, 99)} человек", f"Запчасти {b()} берём у дилера",
                f"Габариты {n(100, 900)}-{n(100, 900)}-{n(10, 99)} мм", f"Арт. {d(4)}-{d(6)}, серия {d(5)}", f"Артикул {d(r.randint(5, 10))}", f"Артикул {d(4)}-{d(6)}", f"Артикул {w()} {d(4)}-{d(6)}, партия {d(5)}", f"Партия {d(5)}, номер {d(4)}-{d(6)}", f"Штрихкод {d(13)}", f"{r.choice(('Рейтинг', 'Балл', 'Оценка', 'Уровень', 'Глава', 'Этап', 'Шаг', w().capitalize()))} {n(1, 9)}{r.choice(('', f',{n(10, 99)}', f',{n(10, 99)} по {n(100, 999)} {n(10, 99)} {n(10, 99)} голосам'))}", f"Оценка {n(3, 4)},{n(10, 99)}, это {n(100, 999)} {n(10, 99)} {n(10, 99)} голосов", f"Заявка {r.choice('6789')}{d(10)} выполнена", f"Заказ {r.choice('6789')}{d(10)} уже отдан", f"Номер заказа {r.choice('78')}{d(10)}", f"Накладная {d(11)} от {n(1, 30)} {r.choice(MONTHS)}", f"Трек-номер {d(14)}", f"Отправление {d(14)} в пути",
                f"Договор № {n(1, 99)}/{n(1, 99)}", f"Счёт № {d(6)} от {n(1, 30)} {r.choice(MONTHS)}", "К технике приложены паспорт и руководство", "Паспорт на счётчик оформим", "Понадобится ИНН организации", "Помогу получить СНИЛС и полис", "Водительские права не нужны", "Подготовлю справку для налоговой, пришлите ИНН", f"Дом {n(6, 12)} на {n(6, 12)} поставим за {n(30, 90)} дней", f"Хватит на квартиру {n(20, 95)} метров", "Подметём двор, улицу и лестницу в подъезде", f"Соберём базу, {n(10, 90)} 000 адресов для писем", f"Стоимость {n(1, 9)} {n(100, 900)} — {n(10, 99)} {n(100, 900)} рублей",
                f"Часы работы {n(6, 11)}-{n(18, 23)}", f"Открыты до {n(20, 23)}:00, {n(100, 999)} отзывов", f"Сумма от {n(5, 200)}00 рублей", f"Акция до {n(1, 30)} {r.choice(MONTHS)}, потом {n(5, 200)}00 рублей", f"{b()} {n(1, 20)} Pro {r.choice((64, 128, 256, 512))}", f"iPhone {n(5, 16)} {r.choice(('Pro', 'Plus', 'mini', 'SE'))} {r.choice((64, 128, 256))}", f"{b()} {d(3)} {r.choice(('W', 'Вт', 'л', 'S', 'XL'))}", f"Модель {b()} {d(4)}, цвет белый", f"Windows {n(7, 11)}, Office {n(2010, 2024)}",
                f"Группа {n(2, 30)} человек, возраст {n(3, 17)} лет", f"Участок {n(2, 30)} соток", f"{r.choice(('Квартира', 'Комната', 'Дом', 'Зал', 'Офис'))} {n(12, 250)} {r.choice(('метра', 'метров', 'м', 'кв. м'))}", f"Подъезд {n(1, 9)}, этаж {n(1, 25)}", f"Район {p()}, рядом {p()}", f"Улица широкая, {n(2, 9)} этажей, {n(1, 9)} подъездов", f"Формат {n(10, 99)} на {n(10, 99)}, код {d(r.randint(5, 9))}", f"Студия {b().capitalize()} {r.choice(('Плюс', 'Сервис', 'Дом', 'Мастер'))}", f"Салон «{b()}» в {p()}", f"Новый {p()}, Верхний {p()}", "Наш специалист вежлив и пунктуален", "Мастер приедет в любой день", "Ваш мастер перезвонит", f"Работа для {b()} и {b()}", f"Санкт-Петербург и {p()}", f"Выезд в Нижний {p()}",
                f"{w()} {p()}".capitalize(), f"{w()} {w()} {b()}".capitalize(), f"Жалобы на {w()} не приняли", f"Сделано {n(2, 95)} заказов, {n(2, 95)} из них в {p()}", f"В наличии {n(2, 95)} шт, скидка {n(5, 95)} процентов", f"Версия {n(1, 9)}.{n(0, 9)}.{n(0, 99)}", f"ГОСТ {d(5)}-{n(10, 99)}", f"ОГРН выдают за {n(2, 9)} дней", f"Счёт {d(20)}", f"Лот {d(8)}", f"Код товара {d(r.randint(5, 9))}",
            )
            text = r.choice(forms)
        how = r.random()
        return text.upper() if how < 0.1 else text.lower() if how < 0.14 else text

    def told(self, kind: str) -> list[str | Span]:
        r, s = self.r, self.span(kind)
        w = self.words(1, 2)
        leads = {
            "phone": ("Телефон: ", "Тел. ", "тел:", "тел ", "Звоните ", "Звонить ", "Мой номер ", "Наш номер ", "Номер телефона ", "номер ", "по номеру ", "Мобильный ", "моб. ", "сот ", "ватсап ", "ватсап/звонок ", "вотсап: ", "вайбер ", "Мессенджер ", "телеграм ", "на связи ", "набирайте ", "диспетчер, ", "дозвон: ", f"{w}: ", f"{w} — ", f"{self.words(1, 3)} — ", "", "", "", "", "", ""),
            "email": ("Почта ", "почта: ", "e-mail: ", "email ", "Адрес почты ", "Электронный адрес ", "мыло ", "ящик ", "Письма на ", "пишите на ", "заявки: ", f"{w}: ", f"{w} на ", f"{w} с ", "", "", ""),
            "id_number": ("", "", "", "", "Данные: ", "мой ", f"{w}, ", f"{w}: ", "для договора ", "по документам: ", "(", "- "),
            "address": ("Адрес: ", "адрес ", "Находимся: ", "Мы тут: ", "Живу: ", "Приём: ", "Мастерская — ", "Склад: ", "Самовывоз: ", "офис ", "по адресу ", f"г. {self.place()}, ", f"город {self.place()}, ", f"{w}: ", f"{w}, ", "", "", ""),
            "person_name": ("Меня зовут ", "зовут ", "Контакт: ", "Контактное лицо: ", "Спросить ", "Обращаться: ", "Исполнитель ", "Мастер ", "мастер ", "ваш мастер ", "Директор ", "Менеджер ", "бригадир ", "Хозяйка — ", "С уважением, ", "Подпись: ", "принимает ", f"{w.capitalize()} ", f"{self.latin(w).capitalize()} ", f"{self.word().capitalize()} ", f"{w} ", f"{w}: ", f"{w} делает ", f"{self.word()} {w} ", "встретит ", "отвечает ", "подписывает ", "ведёт ", "работает ", "хвалят: ", f"{w} {self.syllables(2)}ает ", f"{w} {self.syllables(2)}ит ", f"{self.words(1, 3)} — ", f"в {self.syllables(2)}е ", f"{self.syllables(2)}ом был(а) ", "", "", "", "", ""),
        }[kind]
        tails = {
            "phone": (" в любое время", " до вечера", " (не скрыт)", f" {w}"),
            "email": (" — для заявок", " смотрю утром", f" {w}"),
            "id_number": (", проверить можно сразу", ")", f", {w}"),
            "address": (", вход со двора", ", рядом с парком", f", {w}"),
            "person_name": (" на связи", ", стаж большой", f" {w}", f", {w}", f" делает {w}"),
        }[kind]
        if kind == "address" and r.random() < 0.06:
            # A street in the locative, without a word for street.
            name = self.syllables(r.randint(2, 3)).capitalize() + r.choice(("ской", "ной", "овой", "цкой"))
            return [r.choice(("Живу на ", "Офис на ", "Приходите на ", "магазин на ")), (f"{name}{r.choice((' ', ', '))}{r.randint(1, 150)}", kind), ""]
        before = r.choice(leads)
        if r.random() < 0.08:
            before = before.upper()
        elif r.random() < 0.08:
            before = before.lower()
        return [before, s, r.choice(tails) if r.random() < 0.45 else ""]

    def row(self) -> list[str | Span]:
        r = self.r
        out: list[str | Span] = []
        end = r.choice((". ", ". ", "! ", " — ", " / ", "\n", ", ", " ", "; ", ".\n"))
        for k in range(r.randint(1, 5)):
            if k:
                out.append(end if r.random() < 0.8 else r.choice((". ", ", ", " (", " - ", " ")))
            out += [self.plain()] if r.random() < 0.55 else self.told(r.choice((*KINDS[1:], "person_name", "phone")))
        return [*out, end.rstrip(" ") if r.random() < 0.7 else ""]


def labelled_rows(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(begin, end, kind)]) rows; the same for the same arguments."""
    maker, table = _Maker(seed), []
    for _ in range(rows):
        text, spans = "", []
        for part in maker.row():
            if isinstance(part, tuple):
                spans.append((len(text), len(text) + len(part[0]), part[1]))
                text += part[0]
            else:
                text += part
        table.append((text, spans))
    return table
