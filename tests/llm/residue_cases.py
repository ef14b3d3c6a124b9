"""Texts written for the test: none stands in the labelled table, which holds word classes and shapes only."""

RESIDUE = """Page not found
Please turn on JavaScript in your browser settings
Страница удалена или перемещена
Dear [Your Name], thank you for your order
Здравствуйте, {first_name}! Ваш заказ готов
IndexError: list index out of range
ValueError: invalid literal for int() with base 10
Сайт требует включить сценарии
Текст скоро добавим
Curabitur pretium tincidunt lacus nulla gravida orci
Запрошенный файл не существует
Раздел больше не существует
Карточка товара не найдена, вернитесь на главную
Документ не обнаружен на сервере
Сайт временно недоступен, ведутся технические работы
Сервер перегружен, зайдите позже
Сервис недоступен
Сервер не отвечает
404 Not Found
HTTP 500
Ошибка 503
error 502
Код ошибки 404
500 Internal Server Error nginx
504 Gateway Timeout
429 Too Many Requests
403 Forbidden
HTTP/2 401 Unauthorized
Слишком много запросов с вашего адреса
В доступе отказано
Доступ запрещен администратором
You don't have permission to access this resource
Access to this page is forbidden
Превышено время ожидания ответа от шлюза
The connection has timed out
Не удалось установить соединение с базой данных
Не удалось открыть страницу
Unable to connect to the database server
Failed: could not load the page
Соединение прервано
Connection refused by host
Connection reset by peer
Something went wrong, please reload the page
Упс, что-то пошло не так
Обновите страницу через минуту
Попробуйте обновить страницу ещё раз
Повторите попытку позже
Проверьте написание адреса страницы
Часть функционала недоступна
This page doesn't exist
This link is no longer available
The resource you are looking for has been removed
Traceback (most recent call last): File "app.py", line 3
ZeroDivisionError: division by zero
TypeError: undefined is not a function
ReferenceError: price is not defined
java.lang.IllegalStateException at com.shop.Main.run
System.NullReferenceException: Object reference not set
Uncaught Error: Call to undefined function get_price()
Parse error: syntax error, unexpected end of file
Warning: Undefined array key in catalog.php
Notice: Undefined offset in /srv/cart.php
SQLSTATE[HY000] [2002] no such host
Fatal error: Maximum execution time exceeded
panic: runtime error: index out of range
Segmentation fault (core dumped)
Unhandled exception in thread main
Allowed memory size of 134217728 bytes exhausted
Error establishing connection to database
Здравствуйте, {{ customer.name }}
Скидка {% if vip %}20{% endif %} процентов
Цена <%= product.price %> за штуку
Адрес: ${order.address}
Телефон: #{contact_phone}
Город [[CITY]]
Мастер @@master@@ приедет к вам
Стоимость __PRICE__ рублей
Привет, %USERNAME%, ваш купон готов
Звоните XXX_tel_XXX
Услуга [название услуги] недорого
Приедем в {город} сегодня
Цена [вставьте цену] за метр
Срок <укажите срок> дней
Бригада (впишите название) работает давно
Всего {0} из {1} мест
Осталось %d мест, скидка %s
Стоимость NaN руб за метр
Цена undefined рублей
Выезд за null минут
Привет, [object Object]
Дата начала дд.мм.гггг
Договор от ХХ.ХХ.ХХХХ года
Имя ________ (укажите)
Lorem ipsum dolor sit amet
Pellentesque habitant morbi tristique senectus et netus
Здесь будет текст о компании
Тут появится описание товара
Описание будет позже
Информация будет добавлена позднее
Контент появится скоро
Текст рыба для макета
Рыбный текст нужен для проверки вёрстки
Заглушка текста, замените перед публикацией
TODO добавить описание
FIXME: text
Your text here
Insert your text here
Sample text goes here, replace before publishing
This site is under construction
Сайт в разработке
Coming soon
Тест тест тест
qwerty asdfgh zxcvbn
фыва олдж йцукен
Подзаголовок номер три
Заголовок номер один
Для просмотра включите скрипты в браузере
Активируйте JavaScript и обновите страницу
Разрешите cookies для этого сайта
Please allow cookies to continue
Enable JavaScript to view this site
JavaScript отключён, часть страниц не откроется
Your browser does not support scripts
Браузер не поддерживает JavaScript
Подтвердите, что вы человек
Докажите, что вы не робот
Verify that you are human
Confirm you are not a robot
Проверяем ваш браузер перед входом
Checking your browser
Сайту необходимы cookies и скрипты браузера
This app requires JavaScript, open the page in another browser
Отключите блокировщик рекламы
Disable your adblocker to continue
Без JavaScript сайт не работает
Сценарии отключены в настройках""".split("\n")

CLEAN = """Обучу Python: KeyError и исключения разберём на уроке
Настрою noscript и счётчики на сайте
Пишу SQL, знаю SQLSTATE коды
ReferenceError исправлю за час
Исправлю ошибку 404 на вашем сайте
Исправлю 500 ошибку сервера за вечер
Страница не найдена в поиске? Подскажу, почему
Объясню, почему сайт недоступен по ночам
Починю сайт, если страница не открывается
Восстановлю сайт после сбоя сервера
Настрою сервер, чтобы страницы не отвечали ошибкой 502
Устраню внутреннюю ошибку сервера
Делаю красивые страницы ошибки 404
Помогу, если доступ запрещён к кабинету
Решу проблему, когда превышено время ожидания
Подключу базу, если нет соединения с сервером
Разберу логи: Traceback и прочие ошибки
Курс Python: разберём TypeError и ValueError
Репетитор по Java: исключения, NullPointerException и потоки
Научу читать stack trace и сообщения компилятора
Учу программированию, шаблоны и исключения на практике
Пишу шаблоны писем с полями для имени и города
Составлю шаблон договора и заполню все поля
Сделаю макет с настоящими текстами, без заглушек
Напишу описание для карточки товара
Напишу тексты на сайт вместо рыбы
Наполню сайт, заменю lorem на живые тексты
Верстаю страницы, подключаю скрипты и счётчики
Пишу на JavaScript и TypeScript, опыт пять лет
Помогу включить JavaScript в браузере пожилым людям
Настрою cookies и согласие по закону
Оптимизирую скрипты, чтобы сайт открывался быстрее
Отлажу сценарии умного дома
Разрабатываю сценарии праздников и свадеб
Сценарий мероприятия пишу за два дня
Сниму блокировку, если браузер не поддерживает сайт
Уберу капчу «подтвердите, что вы не робот» с формы
Тестирую сайты: формы, ссылки, скорость
Цена 500 рублей за метр
Стоимость 450 руб, выезд бесплатно
Код домофона 404, второй подъезд
Квартира 503, этаж пятый
Размер 500 на 404 мм
Скидка 20% на второй заказ, 15% на третий
Работаем 24/7, включая праздники
Ремонт стиральных машин: ошибка E9, F05, 4E
Стиральная машина показывает ошибку слива, приедем за час
Холодильник не морозит, посудомойка не работает
Двигатель не заводится, стартер не крутит
Не удалось открыть дверь? Вскроем замок без повреждений
Дверь не открывается, ключ потерян, приедем быстро
Соединение труб, сварка, пайка
Подключение к сети 220 вольт
Подключение интернета и телевидения
Связь с мастером по телефону
Ждём вас на занятиях
Документы готовим за один день
Адрес мастерской рядом с рынком
Ссылки на работы пришлю в чат
Рыба свежая, доставка по городу
Рыба, икра и морепродукты
Копчёная рыба к празднику
Тест на беременность, консультация
Тестовое задание проверяем бесплатно
Пример работы на фото
Образец ткани привезу на замер
Будем рады помочь, пишите скоро отвечу
Описание и фото по запросу
Текст поздравления под заказ
Абзац за абзацем переведу с английского
Заголовки для рекламы придумаю
Включите в стоимость доставку и сборку
Включите воображение, а мы построим
Активируйте карту у администратора
Разрешите пригласить вас на танцы
Отключите воду перед нашим приездом
Проверьте счётчики до поверки
Обновите гардероб недорого
Повторите рецепт дома с нашим шефом
Попробуйте пробный урок бесплатно
Человек человеку помогает, клининг с душой
Я не робот, а живой мастер с опытом? Спросите соседей
Роботы-пылесосы: ремонт и чистка
Доступные цены и честный договор
Доступ к материалам курса навсегда
Запросы клиентов учитываем все
Много работ в портфолио
Слишком много вещей? Вывезем лишнее
Удалён от города на пять километров, выезд включён
Удаление вирусов и настройка принтера
Перемещение мебели и техники
Снято с производства, но запчасти найдём
Закрытые мероприятия и банкеты
Внутренняя отделка квартир и домов
Внутренний блок кондиционера моем отдельно
Временно снижаем цены до конца месяца
Ограничений по площади нет
Больше нет смысла переплачивать
Нет времени на уборку? Поможем
Нет соединения деталей без клея, пояснил столяр
[кроме праздников] скидка 36%
{высота: 13 см} ваза ручной работы
(без выходных) приедем за час
<b>Быстро</b> и <i>недорого</i>
<p>Ремонт</p> <br/> окон
&nbsp;&nbsp; <div class="x">Мебель</div>
Размеры [120 x 60], цвет дуб
Номер в реестре [4521], печать
Оплата (наличные, карта)
Магазин «404» на углу
Версия 4.0.4 прошивки
Письмо на почту, ответ за 24 часа
Не так давно открыли новый зал
Всё пошло хорошо, клиент доволен
Очень очень очень быстро
Да да, приедем и в выходной
Lorem Studio: дизайн интерьеров
Ipsum Cafe, доставка обедов
NULL-модемный кабель, пайка
Undefined Design, логотипы
Курсы Excel: формулы и ошибки #ЗНАЧ
Мастер класс по вёрстке свечей
Вёрстка свадебных альбомов
Макет дома из картона
Заглушки для труб, сантехника
Публикации в журналах по договору
Строительство домов под ключ
В разработке сметы учтём всё
Дизайн-проект на этапе разработки
Сервис по ремонту телефонов
Сервис доступен для всех районов города
Базы отдыха и турбазы
Файлы для гравировки пришлите заранее
Код товара 12345
Проверка документов при встрече
Хостинг и домены: перенос и настройка
Поставлю антивирус и блокировщик рекламы
Контент-план на месяц, тексты для соцсетей""".split("\n")
