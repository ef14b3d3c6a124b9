"""Hand-written sentences, none of them by the maker of the labelled table. Spans stand in braces with their kind:
p phone, e email, i identity number, a address, n name of a person."""

CASES = """Мой номер {p|89161234567}, звоните
тел {p|2-34-56}
Контакт: {n|Мухаммад Каримов}
Набирайте {p|+7 916 123-45-67}, отвечу сразу
Можно в вотсап {p|8(903)555-12-12}
Позвоните мне: {p|8-800-555-35-35}
Связь через телеграм или {p|+7 (495) 123-45-67}
Наш городской {p|245-67-89}, спросите бухгалтерию
{p|+375 29 123 4567} — звонки из Минска
Дозвониться проще вечером, {p|9161234567}
пишите на {p|89031112233} круглосуточно
Кому срочно: {p|8 921 000 11 22}
Диспетчер {p|8.912.345.67.89} работает без перерыва
Телефон мастера: {p|8 9 1 2 3 4 5 6 7 8 9}
Звонить строго после шести, {p|8 927 412 три два 55}
номер такой: {p|восемь девять один шесть 1234567}
Мобильный {p|+79998887766}, вайбер тот же
Тел.: {p|8 (8552) 44-55-66}
Почта для смет: {e|ivan.petrov@example.com}
Шлите фото на {e|zakaz2020@mebel.ru}
{e|info@shop-master.test} ждём писем
Ящик {e|anna_k@mail.example} проверяю утром
Резюме на {e|hr (at) firma.ru}
Адрес почты {e|kuhni собака dom точка ru}
Договор пришлём с {e|no-reply@service.net}
e-mail {e|OFFICE@STROYKA.COM}
Пишите {e|masha.s+work@post.org} или в чат
Эскиз отправлю на ваш ящик, мой {e|dizain[собака]studio.ru}
Паспортные данные: {i|паспорт 4510 123456}
{i|паспорт серия 4510 № 123456}, выдан давно
Работаю по договору, {i|ИНН 770123456789}
Самозанятый, {i|ИНН: 500112345678}
{i|СНИЛС 112-233-445 95} приложу
Оформлю официально ({i|ОГРНИП 304500116000157})
{i|водительское удостоверение 77 16 123456}, категория В
Категории В и С, {i|права 77 16 123456}
Есть {i|полис ОМС 1234567890123456}
Для пропуска нужен {i|паспорт: 4510123456}
{i|СНИЛС: 11223344595}
Юрлицо, {i|ИНН 7701234567}
Моё {i|ВУ 7716 123456} в порядке
Адрес: {a|ул. Ленина, д. 5, кв. 12}
Приезжайте: {a|улица Гагарина, 14}
Склад находится: {a|проспект Мира, дом 101}
Мы на районе, {a|ул. Садовая 7}
Живу на {a|Тверской 12}
Офис: {a|пр-т Вернадского, 41, офис 200}
Самовывоз с адреса {a|пер. Столярный, 3}
{a|Невский проспект, 28}, второй этаж
Заезд с двора, {a|ул Кирова 15к2}
{a|мкр. Северный, д. 4}
Мастерская тут: {a|бульвар Космонавтов, 9}
город Казань, {a|ул. Баумана, д. 33}
Встречаемся: {a|пл. Революции, 2}
Шоурум, {a|ш. Энтузиастов, д. 56}
Забрать можно: {a|наб. реки Фонтанки, 76}
{a|12 Lenina Street, apt 4}
ул на карте есть: {a|переулок Тихий, дом 8}
Меня зовут {n|Сергей Иванов}, опыт десять лет
Обращайтесь, {n|Мария Петровна}
Бригадир {n|Кузнецов Андрей Викторович}
Директор {n|А. С. Пушкарёв}
Мастер {n|Ольга Сергеевна Белова} принимает по записи
Менеджер {n|Смирнова Е.В.} ответит
Спросить {n|Фархода Юсупова} на складе
Спасибо, {n|Наталья Громова}!
Контактное лицо: {n|Ашот Варданян}
Ваш мастер {n|Гурам Кипиани}
{n|НИКОЛАЙ СЕМЁНОВИЧ} объяснит условия
зовут {n|алексей воронцов}, приеду сам
Репетитор {n|Елена Андреевна} готовит к экзамену
Psychologist {n|Anna Sokolova} on site
Работы ведёт {n|Dmitriy Orlov}
Подпись: {n|Лебедев П. Н.}
С уважением, {n|Тимур Гайнутдинов}
Хозяйка — {n|Зинаида Павловна Крылова}
{n|Роман Шевченко}, электрик
За кухню отвечает {n|Виктор Николаевич}
{n|Иванова Светлана}, косметолог
Педагог {n|Маргарита Львовна Штейн}
Исполнитель {n|Игорь Ткачук}
Меня зовут {n|Лейла Ахмедова}, шью платья
iPhone 14 Pro 256
Samsung Galaxy S21 Ultra 512
Модель Bosch 1200 W
Windows 11 и Office 2021
Заказ 89161234567 уже собран
Заказ № 4512 123456 отменён
Артикул 4510-123456
Штрихкод 4607001234567
Трек 80086512345678 едет
Накладная 77012345678 от пятницы
Договор 12/34 от 5 мая
Размер 180-200-40 см
Паспорт изделия в комплекте
Нужен только ИНН заказчика
Помогу оформить СНИЛС ребёнку
Права на квадроцикл не требуются
Полис не нужен
Дом 8 на 10 под ключ
Квартира 54 метра, две комнаты
Двор и улицу убираем зимой
Подъезд чистый, лифт работает
На улице тепло, работаем без куртки
В базе 12 000 адресов
Почта закрыта, отправим курьером
Отвечаю на письма за час
Позвоните в дверь два раза
Номер в гостинице на двоих
Телефоны чиним за час
Скидка 15 процентов до 30 июня
Цена 3 500 — 12 000 рублей
Рейтинг 4,9 по 120 отзывам
Работаем с 9 до 21
Стаж 15 лет, 300 объектов
Участок 12 соток, забор 80 метров
Группа 8 человек, возраст 5 лет
Едем в Нижний Новгород и Казань
Выезд в Санкт-Петербург и область
Доставка по Ростову-на-Дону
Бренд Хёндай, детали в наличии
Обои фабрики Эрисманн
Студия Белый Кролик
Салон «Лаванда» у метро
Кафе Старый Тифлис
Компания Строй Сервис Плюс
Автосервис Форсаж
Магазин Всё для дома
Спектакль про царя и рыбака
Ремонт холодильников недорого
Настройка роялей и пианино
Спил деревьев целиком
Бурение скважин зимой
Сборка шкафов сегодня
Перевозка диванов
Укладка ламината и плитки
Мастер на час, любые мелочи
Честный мастер, чистая работа
Ваш мастер приедет утром
Специалист вежливый и спокойный
Замена стёкол на айфон
Чистка ковров на дому
Вывоз мусора круглый день
Уроки вокала взрослым
Стрижка пуделей и терьеров
Торты на заказ от 2 кг
Пироги с вишней и яблоком
Окна, двери, балконы
Сваи винтовые 108 мм
Бетон М300 с доставкой
Кабель ВВГ 3х2,5
Лада 2107 в разбор
Камаз 10 тонн, песок
Курс доллара 90, оплата в рублях
ГОСТ 30494-2011 соблюдаем
Версия 2.10.4 программы
Счёт 40817810099910004312 в банке
Лот 12345678 снят
Этаж 7, лифт грузовой
Рост 170, вес 65
Играем в футбол 5 на 5
Осталось 3 места
ЕГЭ 2025 на 90 баллов
Фото 10х15 за минуту
ПРОДАЖА КИРПИЧА ОПТОМ
ВЕЗЁМ ГРУЗ ПО РОССИИ
РЕМОНТ КВАРТИР ПОД КЛЮЧ
Дизайн кухонь, 3D проект
Гарантия 24 месяца
Пятница и суббота заняты
Первый урок бесплатно
Печать визиток 500 штук
Оплата по факту
Инструмент наш, материал ваш
Смета за день
Помощь юриста по наследству
Сдам дрель и перфоратор
Прокат лыж и коньков
Куплю монеты СССР
Маникюр с покрытием 1200 рублей
Массаж спины 40 минут
Фотограф на свадьбу
Ведущий и диджей
Няня с проживанием
Сиделка в больницу
Химчистка салона авто
Эвакуатор за 20 минут
Установка Windows и антивируса
Подключим люстру и розетки
Пишите в чат, отвечу
Звоните в любое время
Адрес уточняйте в сообщениях
Паспорт покажу при встрече
Имя мастера указано в заявке
Звоните {p|8 916 123 45 67}, спросить {n|Павла Сергеевича}
{n|Ирина Белкина}, {p|+7 903 111-22-33}, {e|irina@post.ru}
Адрес {a|ул. Лесная, д. 3}, телефон {p|8(499)1234567}
Договор подписывает {n|Орлов И. И.}, {i|ИНН 771234567890}
Самовывоз: {a|ул. Новая, 5}. Почта {e|sklad@firma.com}
Заказ 77012345678 готов, вопросы {p|89261234567}
Мастер {n|Артём Козлов} приедет в Тверь, 5 этаж
{n|Козлова Дарья}: {e|dasha@example.org}, Инстаграм не веду""".split("\n")


def parsed(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    kinds = {"p": "phone", "e": "email", "i": "id_number", "a": "address", "n": "person_name"}
    text, spans = "", []
    while "{" in line:
        head, _, rest = line.partition("{")
        mark, _, line = rest.partition("}")
        kind, _, body = mark.partition("|")
        text += head
        spans.append((len(text), len(text) + len(body), kinds[kind]))
        text += body
    return text + line, spans
