"""The labelled table of residue exemplars, and the terms in which texts and exemplars are written.

An exemplar is a short bag of terms with a label (residue or mention) and a slack, the number of other tokens that a window
may hold besides. Terms are classes of words that play one part in such messages (``PAGE``, ``ENABLE``, ``SCRIPT``), shapes
of unfilled slots (``slot:{}``), negated words (``not:found``), or plain words. The table is made by rule from these classes,
from the reason phrases of the HTTP standard, and from the shapes of common template syntaxes and error messages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus
from itertools import product

# Word classes, as beginnings of words (whole words where they end in $), both languages.
CLASSES = {
    "PAGE": "страниц карточк объявлени раздел сайт ресурс документ$ документа$ файл адрес ссылк контент url$ page$ pages$ listing$ site$ website$ resource$ document$ file$ link$ content$",
    "SERVER": "сервер сервис шлюз$ баз$ база$ базе$ базой$ базы$ server$ service$ gateway$ database$ host$",
    "ERROR": "ошибк сбой$ сбоя$ сбое$ error$ errors$ failure$ код$ code$ http$ статус$ status$",
    "REMOVED": "удален$ удалена$ удалено$ удалены$ снято$ снята$ снят$ перемещен перенесен заархивирован архивирован removed$ moved$ deleted$ archived$",
    "UNAVAIL": "недоступ unavailable$ перегружен",
    "TEMP": "временно$ temporarily$",
    "ACCESS": "доступ$ доступа$ access$ permission$ прав$",
    "DENIED": "запрещен$ запрещен отказано$ denied$ forbidden$ недостаточно$",
    "INTERNAL": "внутрен internal$",
    "MANY": "много$ many$",
    "REQUEST": "запрос request$ requests$",
    "WAIT": "ожидани timeout$ timed$",
    "EXPIRED": "истекл превышен out$ expired$ exceeded$",
    "LOAD": "загрузить$ загрузится$ подключиться$ открыть$ установить$ получить$ отобразить$ load$ connect$ open$ establish$ establishing$ fetch$",
    "CONNECT": "соединени подключени связь$ связи$ connection$",
    "LOST": "прерван потерян разорван refused$ lost$ reset$ сброшен",
    "REFRESH": "обновите$ перезагрузите$ refresh$ reload$",
    "TRY": "попробуйте$ повторите$ попытайтесь$ try$ retry$",
    "LATER": "позже$ позднее$ скоро$ later$ soon$ потом$ дальнейшем$",
    "CHECK": "проверьте$ check$",
    "CHECKING": "проверяем$ проверка$ проверку$ проверяется$ checking$ verifying$",
    "BROWSER": "браузер browser$",
    "ENABLE": "включите$ включить$ включен включена$ включено$ активируйте$ активировать$ активирован разрешите$ разрешить$ разблокируйте$ enable$ enabled$ allow$ turn$",
    "DISABLED": "отключен выключен заблокирован disabled$ blocked$",
    "DISABLE": "отключите$ выключите$ disable$",
    "SCRIPT": "javascript$ js$ скрипт сценари яваскрипт script$ scripts$ scripting$ джаваскрипт",
    "COOKIE": "cookie$ cookies$ куки$ кук$",
    "BLOCKER": "блокировщик adblock$ адблок$ adblocker$ blocker$",
    "REQUIRES": "требует требуются$ требуется$ необходим нужен$ нужны$ нужно$ requires$ require$ required$ need$ needs$ must$ only$ только$",
    "CONFIRM": "подтвердите$ докажите$ убедитесь$ убедимся$ удостоверимся$ verify$ confirm$ prove$",
    "HUMAN": "человек$ человеком$ люди$ human$",
    "TEXT": "текст$ текста$ тексты$ текстом$ описание$ описания$ описанием$ абзац контент информация$ информацию$ содержимое$ text$ content$ description$ paragraph$",
    "FUTURE": "будет$ будут$ появится$ появятся$ добавим$ добавят$ добавится$ допишем$ допишу$ дополним$ заполним$ напишем$ разместим$ coming$ goes$",
    "HERE": "здесь$ тут$ сюда$ here$",
    "STUB": "заглушк рыба$ рыбный$ рыбой$ плейсхолдер placeholder$ dummy$",
    "SAMPLE": "пример$ примера$ образец$ тестов sample$ example$ демонстрационн",
    "MOCKUP": "макет верстк layout$ mockup$ дизайн$ дизайна$ шрифт",
    "REPLACE": "замените$ заменить$ replace$ удалите$ удалить$",
    "PUBLISH": "публикаци publish$ publishing$ publication$ выкладк",
    "WRITE": "написать$ дописать$ добавить$ заполнить$ write$ add$ fill$ вставить$",
    "BUILD": "разработк construction$ реконструкци development$",
    "YOUR": "ваш$ ваше$ ваша$ твой$ your$",
    "TODO": "todo$ тодо$ fixme$ tbd$",
    "HEADING": "заголовок$ подзаголовок$ абзац$ пункт$ heading$ слайд$",
    "NUMBER": "один$ два$ три$ четыре$ первый$ второй$ one$ two$",
    "UNIT": "руб$ рублей$ рубля$ час$ часа$ часов$ день$ дней$ дня$ минут$ метров$ лет$ шт$ км$ процентов$ ₽$",
    "MISSING": "nan$ undefined$ null$",
    # What speaks about such things: what a seller does, teaches or explains.
    "SERVICE": "исправлю$ исправля исправим$ исправление$ исправлением$ восстановлю$ восстанавлива восстановление$ объясню$ объясня объяснение$ помогу$ помога поможем$ настрою$ настраива настройка$ настройку$ устраню$ устраня устраним$ устранение$ решу$ решаю$ решаем$ починю$ чиню$ чиним$ разберу$ разберем$ разбираю$ разбор$ обучу$ обучаю$ обучени научу$ учу$ учим$ курс$ курса$ курсы$ курсе$ урок$ урока$ уроке$ уроки$ лекци репетитор пишу$ пишем$ подскажу$ подскажем$ сделаю$ делаю$ делаем$ сделаем$ создам$ создаю$ составлю$ составляю$ верстаю$ сверстаю$ разработаю$ разрабатываю$ заменю$ поставлю$ отлажу$ отладка$ найду$ проверю$ проверим$ расскажу$ рассказываю$ покажу$ рассмотрим$ подключу$ подключаю$ подготовлю$ уберу$ ремонтирую$ сниму$ оптимизирую$ продвигаю$ продвижение$ программирую$ знаю$ изучим$ изучаем$ fix$ fixing$ teach$ explain$ repair$ консультация$ статья$ книга$ почему$ напишу$ заполню$ переведу$ наполню$ поправлю$ займусь$ избавлю$",
}
# What a negation may bind, what may stand between, and the negations.
NEGATED = {
    "found": "найд обнаруж found$ find$", "exist": "существ exist$ exists$", "open": "откр загруз отобража отобраз load$ loaded$ open$ отвеча respond$ responding$",
    "support": "поддержива support$ supported$", "so": "так$", "robot": "робот$ бот$ robot$ bot$", "avail": "доступ$ доступн available$", "defined": "defined$ function$ callable$",
    "connect": "соединени подключени связи$ connect$ connection$", "able": "удалось$ удается$ able$", "set": "set$", "working": "работает$ working$", "permission": "прав$ доступа$ permission$", "authorized": "авторизован authorized$",
}
BETWEEN = {"be", "been", "была", "был", "было", "быть", "может", "могут", "удалось", "currently", "yet", "have", "были", "an", "a", "временно", "или"}
NEGATIONS = {"не", "нет", "not", "cannot", "doesn", "isn", "don", "couldn", "can", "wasn", "aren", "unable", "без"}
#: Words of the usual pseudo-Latin filler.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum vestibulum curabitur pretium tincidunt lacus pellentesque habitant morbi tristique "
    "senectus netus malesuada fames turpis egestas aenean ultricies mauris vitae praesent justo fusce nunc vel nibh phasellus vivamus suspendisse faucibus lectus ornare donec integer maecenas nullam cras posuere cursus mattis mollis at et ut ac eu id in non per ante diam erat "
    "quam sapien tellus urna viverra volutpat vulputate sagittis rhoncus porttitor placerat orci nec ligula laoreet interdum hendrerit gravida feugiat euismod efficitur eget dui dictum convallis condimentum blandit bibendum augue auctor arcu aliquet accumsan".split()
)
ROWS_OF_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
# Nouns that name a field of a template, and verbs that ask to fill one.
FIELDS = "имя имени название названи описание цена цены город города срок телефон телефона адрес дата даты услуга услуги мастер мастера компания компании сумма время скидка район номер почта фамилия товар товара брэнд бренд модель клиент клиента ваше ваш name title price city phone email date address company discount brand description region deadline first last product amount link".split()
FILL = "вставить вставьте вставь указать укажите введите ввести впишите вписать заполнить заполните подставить подставьте добавьте insert enter your fill put add".split()


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    form = lambda words: re.compile("|".join(f"{w[:-1]}$" if w.endswith("$") else w for w in words.split()))
    return {name: form(words) for name, words in CLASSES.items()} | {f"not:{name}": form(words) for name, words in NEGATED.items()}


def _classed(low: str) -> str | None:
    for name in CLASSES:
        if _patterns()[name].match(low):
            return name
    return None


# The shapes of slots, values and messages; what is between two different marks may be of any length.
_SHAPES = (
    ("slot:{{}}", r"\{\{(?:(?!\{\{)[\s\S])*?\}\}"), ("slot:{%%}", r"\{%(?:(?!\{%)[\s\S])*?%\}"), ("slot:<%%>", r"<%(?:(?!<%)[\s\S])*?%>"), ("slot:${}", r"\$\{[^{}]*\}"), ("slot:#{}", r"#\{[^{}]*\}"),
    ("slot:[[]]", r"\[\[(?:(?!\[\[)[\s\S])*?\]\]"), ("slot:@@", r"@@ ?[^\W\d][\w. -]{0,60}?@@"), ("slot:__", r"__(?!(?:init|name|main|str|repr|call|doc|file|dict|len|iter|next|new|all|version)__)[^\W\d_][\w.]*?__"),
    ("slot:%%", r"%[^\W\d][\w. ]{0,40}?(?<=[^\W\d])%"), ("slot:xxx", r"xxx_[\w ]+?_xxx"), ("value:object", r"\[object object\]"), ("printf", r"(?<!\w)%[sdif]\b"), ("slot:{0}", r"\{\d\}"),
    ("slot:{}", r"\{\s*[^\W\d_][\w.]*(?: [^\W\d_][\w.]*){0,2}\s*\}"), ("?[", r"\[[^\[\]\n]{1,60}\]"), ("?<", r"<[^<>\n]{1,200}>"), ("?(", r"\([^()\n]{1,40}\)"),
    ("datemask", r"\b[xх]{2}\.[xх]{2}\.[xх]{2,4}\b|\bдд\.мм\.гг(?:гг)?\b|\bdd\.mm\.yyyy\b"), ("blank", r"_{4,}"),
    ("exception:", r"(?:[a-z_]\w*[.\\])*(?-i:[A-Z])\w*(?-i:Error|Exception|Warning)(?=\s*:)|(?:[a-z]\w*[.\\])+(?-i:[A-Z])\w*(?-i:Error|Exception)\b"), ("sqlstate[", r"\bsqlstate(?=\s*\[)"), ("http", r"\bhttps?/\d(?:\.\d)?"),
    ("¶", r"[.!](?=\s|$)|\n"), ("?", r"\?"), ("", r"[^\W_]+"),
)
_TOKEN = re.compile("|".join(f"({p})" for _, p in _SHAPES), re.I)
_INVISIBLE = frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
#: Texts without such a mark, or such a piece, hold words and ends of sentences only.
_MARK = re.compile(r"[{}\[\]<>@%$#_(]")
_PIECES = ("Error", "Exception", "Warning", "xx.", "XX.", "хх.", "ХХ.", "Xx.", "Хх.", "дд.", "ДД.", "dd.", "DD.", "HTTP", "http", "Http")
_PLAIN = re.compile(r"[^\W_]+|[.!](?=\s|$)|\n|\?")
_WORD = re.compile(r"[^\W_]+")
_NAMED = re.compile(r"[^\W\d_]+(?:[_.][^\W_]+)+|[a-z]+[A-Z]\w*")


def _bracketed(kind: str, raw: str) -> str | None:
    """Whether words in single brackets are a slot: an identifier, a field's name, or an order to fill it."""
    inner = raw[1:-1].strip()
    words = [w.lower().replace("ё", "е") for w in _WORD.findall(inner)]
    if not words or len(words) > 6 or kind == "?<" and (inner.startswith(("/", "!")) or "=" in inner or '"' in inner):
        return None
    if kind == "?(" and words[-1] in ("заполнить", "заполните", "вписать", "впишите", "вставить"):
        return "slot:fill"
    if words[0] in FILL and (kind == "?(" or len(words) > 1 or words[0] != "your"):
        return "slot:fill" if kind != "?(" or words[0] not in ("your", "add", "put", "enter") else None
    if kind == "?(":
        return None
    if _NAMED.fullmatch(inner) or len(words) <= 3 and all(w in FIELDS for w in words):
        return "slot:[]"
    return None


@lru_cache(maxsize=1 << 17)
def word_term(raw: str) -> str:
    """The term of a word: its class, or itself in lower case."""
    low = raw.lower().replace("ё", "е")
    if low.isdigit():
        return "httpcode" if len(low) == 3 and low[0] in "45" else low
    if name := _classed(low):
        return name
    if low in LATIN:
        return "latin"
    if len(low) >= 4 and any(low in row for row in ROWS_OF_KEYS):
        return "keys"
    return low


@lru_cache(maxsize=1 << 14)
def _negated(raw: str) -> str | None:
    low = raw.lower().replace("ё", "е")
    return next((f"not:{n}" for n in NEGATED if _patterns()[f"not:{n}"].match(low)), None)


class _Memo(dict):
    """Per word its lower case, term, and bound negation; per mark its term alone."""

    def __missing__(self, raw: str) -> tuple[str | None, str, str | None]:
        if raw in (".", "!", "\n", "?"):
            out = (None, "?" if raw == "?" else "¶", None)
        else:
            low = raw.lower()
            out = (low, word_term(raw), _negated(raw))
        if len(self) > 1 << 18:
            self.clear()
        self[raw] = out
        return out


_MEMO = _Memo()


def _shaped(text: str) -> Iterator[tuple[str | None, str, str | None]]:
    """The pieces of a text that may hold slots, values and messages."""
    for m in _TOKEN.finditer(text):
        shape = _SHAPES[m.lastindex - 1][0]
        if not shape:
            yield _MEMO[m.group()]
        elif shape[0] == "?" and len(shape) > 1:
            if slot := _bracketed(shape, m.group()):
                yield None, slot, None
            elif shape != "?<":
                yield from (_MEMO[w] for w in _WORD.findall(m.group()))
        else:
            yield None, shape, None


def residue_terms(text: str) -> list[str]:
    """The terms of a text in their order: compatibility forms, case, ё/е, invisible characters and spacing don't matter."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if not _INVISIBLE.isdisjoint(text):
            text = "".join(c for c in text if c not in _INVISIBLE)
    if _MARK.search(text) or any(x in text for x in _PIECES):
        pieces = _shaped(text)
    else:
        memo = _MEMO
        pieces = (memo[w] for w in _PLAIN.findall(text))
    out: list[str] = []
    waiting, since, last, run = 0, 0, "", 0
    for low, term, bound in pieces:
        if low is None:
            waiting = 0
        elif low == last:
            run += 1
            if run == 3 and len(low) > 2 and low not in ("очень", "ура"):
                out.append("thrice")
        else:
            last, run = low, 1
        if waiting and low is not None:
            if bound:
                # The negation, what stands between, and the word become one term.
                del out[since:]
                out.append(bound)
                waiting = 0
                continue
            waiting = waiting - 1 if low in BETWEEN or low == "t" else 0
        if low in NEGATIONS:
            if low == "нет" and out and out[-1] == "больше":
                out[-1] = "gone"
                continue
            waiting, since = 3, len(out)
        elif low == "longer" and out and out[-1] == "no":
            out[-1] = "gone"
            continue
        out.append(term)
    return out


# Residue exemplars as (slack, classes); | gives alternatives.
_RESIDUE = (
    # error pages
    (3, "PAGE not:found|not:exist|gone|not:open"), (2, "PAGE|SERVER UNAVAIL|not:avail"), (3, "PAGE REMOVED"), (2, "SERVER not:open|not:connect"), (0, "ERROR httpcode"), (1, "httpcode not:found"), (1, "INTERNAL ERROR SERVER"), (1, "ACCESS DENIED"), (1, "ACCESS not:avail"),
    (1, "слишком MANY REQUEST"), (1, "too MANY REQUEST"), (2, "WAIT EXPIRED"), (2, "not:connect SERVER|internet|интернетом|сетью|сети"), (2, "CONNECT LOST|UNAVAIL"), (2, "not:able LOAD PAGE|SERVER|CONNECT"), (2, "not:able CONNECT"), (2, "ERROR LOAD SERVER CONNECT"), (1, "пошло not:so"), (0, "something went wrong"),
    (2, "REFRESH PAGE|BROWSER"), (2, "TRY обновить|перезагрузить|again|reload PAGE"), (3, "TRY LATER"), (3, "CHECK PAGE строке|BROWSER|написания|spelling"), (3, "PAGE not:open настройки"), (1, "функций|функции|функционал UNAVAIL|not:avail"), (1, "you don permission"), (1, "UNAVAIL TEMP"), (1, "TEMP not:avail"), (1, "TEMP not:working PAGE|SERVER"),
    (2, "REQUEST not:found|not:exist"), (2, "запрошенная|запрошенный|запрашиваемая|requested PAGE not:found|not:exist|gone"), (1, "технические работы SERVER|PAGE"), (1, "maintenance mode|under"), (1, "not:authorized"),
    # program errors
    (0, "exception:"), (0, "sqlstate["), (1, "traceback most recent"), (1, "cannot read properties|property"), (0, "fatal ERROR"), (0, "parse ERROR"), (0, "syntax ERROR"), (1, "syntax ERROR unexpected"), (1, "MISSING variable|index|offset|method|property|constant|array"), (1, "call to MISSING"), (1, "allowed memory size"), (0, "segmentation fault"), (0, "core dumped"), (1, "unhandled|uncaught exception|error|ERROR"),
    (1, "object reference not:set"), (2, "table or view not:found"), (0, "stack trace"), (1, "index out of range|bounds"), (1, "runtime ERROR"), (1, "division by zero"), (1, "MISSING is not:defined"), (2, "is not:defined"), (1, "ERROR establishing SERVER CONNECT"), (2, "ERROR LOAD SERVER CONNECT"), (1, "null pointer"), (1, "CONNECT LOST by"), (2, "out of memory ERROR"),
    # unrendered values
    (0, "MISSING UNIT"), (0, "MISSING MISSING"), (0, "value:object"), (3, "printf printf"), (0, "datemask"), (3, "blank впишите|укажите|заполните|вписать"),
    # filler
    (1, "latin latin latin latin latin"), (0, "latin latin latin"), (2, "keys keys"), (0, "thrice"), (1, "STUB TEXT"), (1, "TEXT STUB"), (3, "REPLACE PUBLISH"), (3, "TEXT FUTURE LATER"), (2, "HERE FUTURE TEXT"), (3, "TEXT WRITE LATER"), (3, "какой то TEXT FUTURE|LATER"), (5, "SAMPLE TEXT MOCKUP"), (3, "TEXT для CHECKING|заполнения|проверки MOCKUP"), (1, "SAMPLE TEXT FUTURE HERE"), (1, "SAMPLE TEXT HERE"), (1, "YOUR TEXT HERE|FUTURE"), (1, "insert YOUR TEXT"), (2, "TODO TEXT|WRITE"),
    (1, "PAGE|SERVER находится в BUILD"), (0, "PAGE|SERVER в BUILD"), (2, "PAGE|SERVER under BUILD"), (3, "TEXT FUTURE добавлено|добавлен|добавлены|дополнено|размещено"), (0, "HEADING номер NUMBER"), (0, "coming LATER"), (0, "FUTURE LATER TEXT"), (2, "TEXT FUTURE на этом|месте"),
    # notices
    (3, "ENABLE SCRIPT|COOKIE"), (3, "DISABLED SCRIPT|COOKIE"), (3, "BROWSER not:support"), (2, "CHECKING BROWSER"), (3, "CONFIRM not:robot|HUMAN"), (3, "you are not:robot"), (3, "REQUIRES SCRIPT|COOKIE PAGE|BROWSER|app|приложение|приложения"), (3, "DISABLE BLOCKER"), (3, "без SCRIPT not:open|not:working"), (2, "SCRIPT|COOKIE PAGE not:open"), (2, "я not:robot"), (1, "докажите HUMAN"),
)
_SLOTS = ("slot:{{}}", "slot:{%%}", "slot:<%%>", "slot:${}", "slot:#{}", "slot:[[]]", "slot:@@", "slot:__", "slot:%%", "slot:xxx", "slot:{}", "slot:{0}", "slot:[]", "slot:fill")
#: A mention: what a seller does, together with a message's terms, with at most so many other tokens. Only messages can be
#: spoken about; an unfilled slot or an unrendered value is one wherever it stands.
ABOUT, ABOUT_SLACK = "SERVICE", 5
_SHOWN = {*_SLOTS, "exception:", "sqlstate[", "value:object", "printf", "datemask", "blank", "latin", "thrice", "MISSING"}


@lru_cache(maxsize=1)
def exemplars() -> tuple[tuple[bool, int, tuple[str, ...]], ...]:
    """The residue exemplars: (whether it can be spoken about, slack, terms)."""
    plain = lambda t: word_term(t) if t.isalpha() and t.islower() and t not in ("latin", "keys", "thrice", "printf", "datemask", "blank", "gone", "httpcode") else t
    rows = [(0, (s,)) for s in _SLOTS]
    for slack, form in _RESIDUE:
        rows += [(slack, tuple(map(plain, x))) for x in product(*(w.split("|") for w in form.split()))]
    for s in HTTPStatus:
        if s.value >= 400:
            terms = tuple(residue_terms(s.phrase))
            rows.append((0, terms if len(terms) > 2 or s.value == 502 else (*terms, "httpcode")))
    return tuple((not set(terms) & _SHOWN, slack, terms) for slack, terms in dict.fromkeys(rows))
