import pytest

from quern.llm import residue, residue_labels

from residue_cases import CLEAN as CLEAN_UNSEEN
from residue_cases import RESIDUE

FOUND = [
    "Страница  не найдена", "ОШИБКА 404.", "HTTP/1.1 504 The page you requested could not be found", "Мастер {{ имя }} приедет вовремя", "Работа за {PRICE} рублей и сегодня",
    "Приедем в [вставить город] к утру", "Пишите XXX_phone_XXX в чат", "Берём undefined рублей за null час", "Сделаем [object Object] быстро", "Lorem ipsum amet dolor sed elit magna quis.",
    "Чтобы продолжить, подтвердите, что вы не робот", "You need to enable JavaScript to run this app", "TODO: написать описание", "Прайс %s от %d руб.", "Дата ХХ.ХХ.ХХХХ уточняется",
    "Traceback (most recent call last):", "TypeError: Cannot read properties of undefined (reading 'mori')", "<h1>Bad​ Gateway", "Хорошая работа. " * 3000 + "Внутренняя ошибка сервера. " + "Советую. " * 3000,
]
CLEAN = [
    None, "", "  \n", "<h1>&nbsp;</h1> <br>", "Страница не найдена в поиске? Подскажу, как продвинуть Мимифукс.", "Восстановлю сервер после сбоя 502, объясню причину.", "Помогу, если браузер блокирует скрипты оплаты.",
    "Пишу на JavaScript, включая скрипты для каталога Rovepit.", "Составлю шаблон договора и заполню поля за вас.", "Скидка 36% по будням [кроме праздников], размеры {высота: 13 см}.", "Исправляю на сайтах ошибку 404 и настраиваю страницы входа за 500 рублей.",
    "Учу программированию: исключения, шаблоны, переменные.", "Сделаю макет с настоящими текстами, без заглушек.", "Стиральная машина показывает ошибку E9, делаем ремонт.", "Цена 500 рублей, код 12", "Приехали к утру, привезли тестер.",
]


@pytest.fixture(scope="module")
def rows():
    texts = FOUND + CLEAN
    return [(k, t, "x") for k, t in enumerate(texts)] + [(1000 + k, "Мастер вежливый, делает плавно за один день.", "x") for k in range(300)] + [(0, FOUND[0], "x"), (None, FOUND[1], "x")]


def test_residue(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, entry string")
    got = [x["doc_id"] for x in residue.residue_documents(df).collect()]
    assert sorted(x for x in got if x is not None) == list(range(len(FOUND))) and got.count(None) == 1
    kept = {x["doc_id"] for x in residue.clean_documents(df).collect()}
    assert kept == {k for k, _, _ in rows if k is None or k >= len(FOUND)}
    assert residue.residue_documents(df.limit(0)).count() == 0


def found(text):
    return bool(residue.ResidueIndex().windows(residue_labels.residue_terms(text)))


def test_unseen_texts():
    """Texts that stand in no exemplar: at least nine in ten are told right, each way."""
    assert len(set(RESIDUE)) >= 100 and len(set(CLEAN_UNSEEN)) >= 100
    missed, wrong = [t for t in RESIDUE if not found(t)], [t for t in CLEAN_UNSEEN if found(t)]
    assert len(missed) < 0.1 * len(RESIDUE), missed
    assert len(wrong) < 0.1 * (len(RESIDUE) - len(missed) + len(wrong)), wrong


def test_long_texts_take_linear_time():
    assert not found("{{ не закрыто " * 20_000) and found("Хорошая работа. " * 20_000 + "{{ x }}")


def test_weights_decide_long_exemplars():
    index = residue.ResidueIndex()
    n = next(k for k, (_, _, own) in enumerate(index.entries) if len(own) > residue.WHOLE)
    own = index.entries[n][2]
    full = (1 << len(own)) - 1
    even = {m for k, m in index.sufficient({}, 1000) if k == n}
    rare_first = {m for k, m in index.sufficient({t: 900 for t in own}, 1000) if k == n}
    assert full in even and full in rare_first


def test_slots_of_any_length_are_residue():
    assert all(map(found, ["Цена {{ price | default('x') | round(2) }} руб", "Адрес {{ order.delivery.address.street.name }}", "{% if user.is_active and user.has_paid %} да"]))
    assert not any(map(found, ["Цена }} без начала, затем совсем другие слова подряд и лишь потом {{ без конца", "Обычный текст мастера"]))
