"""Word lists of the domain. All are parameters of the operators; these are the defaults."""

# Event types, markers and patterns of the domain's rules.
EVENT_TYPES = ["STOP_UNPLANNED", "START", "TEST_RUN", "START_GENERAL", "INFO"]

WEATHER_MARKERS = [
    "погод", "температур", "холод", "ветер", "влаж", "дожд", "снег", "мороз", "осадки", "осадков", "сохнет",
    "обильного количества воды", "луж",
]
TECHNICAL_MARKERS = [
    "тех", "не запуска", "не запуст", "механик", "ремонт", "замена", "ошибка", "потеря связи", "нет подачи питания",
    "питани", "компрессор", "бугел", "полом", "внеплан", " то", "продлен", "модул", "сбой", "неисправ", "креплен",
    "прижимн", "платформ", "исходн",
]
GENERIC_REASONS = ["внеплановый стоп", "стоп аттракциона", "остановка аттракциона", "закрытие продаж"]
REASON_PATTERNS = [
    "(потеря связи)", "(ошибка [^.,;]+)", "(завис [^.,;]+)", "(не запускается|не запустился|не запустилась|не запустились)",
    "(нет подачи питания[^.,;]*)", "(ремонт [^.,;]+)", "(замена [^.,;]+)", "(проверка работы [^.,;]+)",
    "(ведутся технические работы)", "(тех(?:нические)? неполадки)", "(техническая поломка|поломка[^.,;]*)",
    "(неисправн(?:ость|ости)? [^.,;]+)", "(не открываются крепления)", "(платформа не в исходной)",
    "(не закрываются прижимные механизмы)", "(продление то)",
]
START_MARKERS = ["в работе", "готов к работе", "готова к работе", "готовы к работе"]
GENERIC_QUOTES = ["стоп", "в стопе"]
FUTURE_MARKERS = ["завтра", "послезавтра", "на завтра", "со следующего дня", "на следующей неделе"]
TODAY_MARKER = "сегодня"
TEST_MARKERS = ["тестовый", "прокат"]
TEST_PREFIX = "[Тест] "
NO_STOPS = "работал без остановок"
#: Fixed value: the line of an export without notices.
EMPTY_RANGE = "# Нет сообщений за выбранный диапазон дат."
# Phrases that name a cause, and what they become.
MECHANIC_PHRASES = [
    ("механик на месте", "Механик на месте"),
    ("механик в пути", "Механик в пути"),
    ("механики в пути", "Механик в пути"),
    ("механика вызвали", "Механик вызван"),
    ("механик вызван", "Механик вызван"),
]
DEFAULT_CAUSE = "Внеплановая техническая остановка"
# What is cut off a reason, and the characters at its ends.
REASON_OUTER = " .,:;\"'«»"
REASON_PREFIX = r"^(?:из-за|из за|по причине|причина[:\s-]*)\s+"
REASON_TAIL = r"\s+(?:прошу|продажи|просьба|механик|механики|гостей|эвакуация|ориентировочное|можно открывать)\b.*"
# Patterns of visitor incidents.
VISITOR_PATTERNS = [
    r"\b(?:мальчик|девочк|реб[её]нок|дет[еи]|посетител[ьяи]?|гость|гости)\b.{0,40}(?:упал|упала|упали|травм|потерял|потерялась|наш[её]лся)",
    r"\b(?:упал|упала|травм|потерял|потерялась|наш[её]лся)\b.{0,40}(?:мальчик|девочк|реб[её]нок|посетител|гость|гости)",
]
# Markers of park-wide and of foreign notices.
GLOBAL_MARKERS = [
    "все аттракционы", "всех аттракционах", "все уличные аттракционы", "аттракционы орион", "аттракционы вднх", "парк закрыт",
    "парк открыт", "продажи закрыты", "продажи открыты", "продажи прошу не открывать",
]
FOREIGN_MARKERS = [
    "учебный полетный центр", "автошкола ориона", "шахта ориониума", "театр сказок", "дом страхов", "воздушный трамвай", "кинопанорама",
]
GENERAL_HINT = "Общее"
# The roster at a notice's end, day labels, months, labels of reports, flags and hours.
ROSTER_TAIL = r"\bВ смене\s*:.*"
TODAY_LABEL, YESTERDAY_LABEL = "сегодня", "вчера"
MONTHS_OF = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]
TOTAL_LABEL = "Итого"
HOUR_LABEL, MINUTE_LABEL = " ч. ", " мин."
SHORT_HOUR, SHORT_MINUTE = "ч", "м"
INCLUDE_FLAGS = ["", "1", "yes", "true", "да"]
OPEN_CLOSE = {"weekday": ("09:00", "22:00"), "weekend": ("09:00", "23:00")}
# Characters that damaged text shows, and the code pages that are tried.
DAMAGE_SCORES = {
    "single": (["Р”", "Рѕ", "Р°", "Рµ", "Рё", "Рљ", "Рќ", "С‚", "СЂ", "СЃ", "СЊ", "С‹", "СЋ", "вЂ", "Ð", "Ñ"], 1),
    "best": (["РІР‚", "РІвЂћ", "в„", "вЂ", "тА"], 20),
}
BOX_SCORE = 5
CODEPAGES = ["cp1251", "cp866", "cp850", "koi8-r", "latin-1"]
