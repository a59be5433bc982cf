"""Word lists of the detection and storage rules."""

from __future__ import annotations

# Word lists that results depend on, each in its natural order.

PHONE_KEYWORDS = (
    "тел", "телефон", "phone", "phone number", "telephone", "mobile phone", "mobile number",
    "contact number", "cell phone", "моб", "контакт", "контактный", "номер",
)

NAME_KEYWORDS = (
    "фио", "first name", "last name", "middle name", "middle initial", "given name", "forename", "surname",
    "family name", "получатель", "сотрудник", "заказчик", "customer_name", "customer name", "employee",
    "employee name", "full name", "applicant", "recipient", "contact person", "name", "requester",
    "requestor",
)

PERSON_MARKERS = (
    "физическое лицо", "person", "employee", "subject", "субъект", "получатель", "заказчик", "requester",
    "requestor", "applicant", "recipient", "contact person",
)

COMPANY_MARKERS = (
    "ооо", "оао", "пао", "ао", "ип", "ltd", "limited", "llc", "inc", "corp", "corporation", "company", "co.",
    "компания", "партнеры", "university", "institute", "department", "agency", "bank", "office", "«",
)

ADDRESS_KEYWORDS = (
    "address", "address line", "street address", "mailing address", "home address", "residential address",
    "residence address", "permanent address", "registered address", "shipping address",
    "destination_address", "адрес", "регистрации", "проживания", "доставки",
)

ADDRESS_MARKERS = (
    "г.", "гор.", "город", "ул.", "улица", "пр.", "пр-кт", "пер.", "бул.", "наб.", "д.", "дом", "кв.",
    "стр.", "обл.", "с.", "п.",
)

ENGLISH_ADDRESS_MARKERS = (
    "street", "st.", "road", "rd.", "avenue", "ave.", "boulevard", "blvd", "lane", "ln.", "drive", "dr.",
    "court", "ct.", "place", "pl.", "way", "apt", "apartment", "suite", "unit", "floor", "city", "state",
    "zip", "postal code",
)

ENGLISH_BIRTH_PLACE_MARKERS = (
    "city", "state", "county", "district", "province", "region", "country", "town",
)

BIRTH_DATE_KEYWORDS = (
    "дата рождения", "birth date", "date of birth", "date_of_birth", "birth_date", "dob",
)

BIRTH_PLACE_KEYWORDS = (
    "место рождения", "birth place", "place of birth", "place_of_birth", "birthplace", "city of birth",
    "country of birth",
)

BIRTH_PLACE_MARKERS = (
    "г.", "город", "гор.", "обл.", "область", "край", "республика", "с.", "пос.", "дер.", "р-н",
)

PASSPORT_KEYWORDS = (
    "паспорт", "паспорт рф", "passport", "серия", "номер",
)

CARD_KEYWORDS = (
    "card", "карта", "visa", "mastercard", "мир", "pan",
)

ACCOUNT_KEYWORDS = (
    "счет", "счёт", "account", "расчетный счет", "расчётный счёт", "р/с",
)

BIK_KEYWORDS = (
    "бик", "bik",
)

CVV_KEYWORDS = (
    "cvv", "cvc", "cvv/cvc",
)

IDENTIFIER_KEYWORDS = (
    "number:", "id:", "_id:", "incident", "created:", "updated:", "begin:", "end:",
)

SUBJECT_MARKERS = (
    "субъект", "гражданин", "пациент", "клиент", "сотрудник", "employee", "person", "фио",
)

LABELED_PATTERNS = (
    ("biometric", "fingerprints", ("отпечатки пальцев", "fingerprints",)),
    ("biometric", "iris_pattern", ("радужка", "радужная оболочка", "iris",)),
    ("biometric", "voice_print", ("голосовой образец", "voice sample", "voiceprint",)),
    ("biometric", "face_geometry", ("геометрия лица", "face geometry", "face recognition",)),
    ("special", "health_data", ("состояние здоровья", "диагноз", "медицинские данные",)),
    ("special", "religious_beliefs", ("вероисповедание", "религиозные убеждения",)),
    ("special", "political_beliefs", ("политические убеждения", "политические взгляды",)),
    ("special", "race_data", ("расовая принадлежность", "раса",)),
    ("special", "nationality_data", ("национальность", "национальная принадлежность",)),
    ("special", "special_category_other", ("интимная жизнь", "сексуальная жизнь",)),
)

PERSON_NAME_SCHEMA_HINTS = (
    "customer_name", "customer name", "person_name", "employee", "employee_name", "employee name", "fio",
    "фио", "full_name", "full name", "first_name", "first name", "last_name", "last name", "middle_name",
    "middle name", "middle initial", "given name", "forename", "surname", "family name", "requester",
    "requestor", "applicant", "recipient", "contact person",
)

STRONG_SCHEMA_HINTS = {
    "person_name": (
        "customer_name", "customer name", "person_name", "employee", "employee_name", "employee name", "fio",
        "фио", "full_name", "full name", "first_name", "first name", "last_name", "last name", "middle_name",
        "middle name", "middle initial", "given name", "forename", "surname", "family name", "requester",
        "requestor", "applicant", "recipient", "contact person",
    ),
    "address": (
        "destination_address", "address", "registered_address", "delivery_address", "mailing address",
        "home address", "residential address", "residence address", "permanent address", "street address",
        "address line", "адрес",
    ),
    "phone": (
        "phone", "phone number", "telephone", "mobile", "mobile phone", "contact_phone", "contact number",
        "телефон", "тел",
    ),
    "email": (
        "email", "e-mail", "почта",
    ),
    "snils": (
        "snils", "снилс",
    ),
    "inn_individual": (
        "inn", "инн",
    ),
    "inn_legal_entity": (
        "inn", "инн",
    ),
    "birth_date": (
        "birth", "birth date", "date of birth", "birth_date", "date_of_birth", "dob", "дата рождения",
    ),
    "birth_place": (
        "birth_place", "birthplace", "place_of_birth", "place of birth", "city of birth", "country of birth",
        "место рождения",
    ),
    "bank_card": (
        "card", "pan", "номер карты", "банковская карта",
    ),
    "bank_account": (
        "account", "счет", "счёт", "расчетный счет",
    ),
    "bik": (
        "bik", "бик",
    ),
}

ID_HEAVY_FIELD_MARKERS = (
    "id", "_id", "uuid", "guid", "token", "hash", "checksum", "incident", "status", "created", "updated",
    "timestamp", "plan", "product", "catalog", "code", "key",
)

XLS_DECLARATION_MARKERS = (
    "декларац", "сведения о доход", "декларацион", "объекты недвижимости", "вид объекта",
    "несовершеннолетний ребенок", "супруг", "на сайт",
)

XLS_ORG_CONTACT_MARKERS = (
    "университет", "академия", "должность", "проректор", "начальник", "управлен", "библиотек",
    "международным связям", "научной работе",
)

DOCX_SHORTLIST_MARKERS = (
    "анкет", "anketa", "заявлен", "zayav", "соглас", "sogl", "договор", "dogovor", "доверен", "doverenn",
    "регистрац", "registration", "воинск", "паспорт", "snils", "снилс", "инн", "dms", "учет", "учёт",
)

DOCX_EXCLUDE_MARKERS = (
    "шаблон", "template", "форма", "образец", "policy", "politika", "cookies", "инструкц", "instruction",
    "syllabus", "course", "гост", "gost", "приказ", "порядок", "перечень", "программа", "program", "семинар",
    "список", "spisok", "finalist", "research", "environmental", "water quality", "oil pollution",
    "congreso", "horario", "wiley",
)

DOCX_SITE_MARKERS = (
    "выгрузки/сайты", "sites", "доки",
)

PERSONAL_STANDALONE_STRONG_CATEGORIES = (
    "passport_series_number", "snils", "driver_license", "mrz", "bank_card",
)

PERSONAL_ANCHOR_CATEGORIES = (
    "person_name", "passport_series", "passport_number", "passport_series_number", "snils", "inn_individual",
    "driver_license", "mrz", "bank_card",
)

PERSONAL_COMPANION_CATEGORIES = (
    "address", "phone", "email", "birth_date", "birth_place",
)

IMAGE_PUBLIC_MARKERS = (
    "curriculum vitae", "certificate of insurance", "curriculum", "resume", "cv", "university of",
    "medical center",
)

PDF_PUBLIC_SOURCE_MARKERS = (
    "выгрузки/сайты/доки", "документы партнеров",
)

PDF_PUBLIC_MARKERS = (
    "privacy", "policy", "terms", "cookies", "agreement", "processing", "report", "progress report",
    "feedback analysis", "information", "brochure", "article", "news", "mediakit", "price-list",
    "presentation", "outlook", "disclosure", "description", "profile", "admission", "protocol", "registry",
    "extract", "register", "plan", "public report", "публич", "информация", "политика", "правила",
    "правила приема", "соглашение", "обработк", "kişisel veri", "aydınlatma metni", "kvkk", "отчет", "отчёт",
    "рапорт", "протокол", "реестр", "реестров", "выписка", "самообслед", "медиакит", "координаты для связи",
    "программа", "положение", "приказ", "инструкция", "заработной плат", "среднемесячн", "главных бухгалтер",
    "руководителей", "лиценз", "аккредит", "license", "accreditation", "neutrality", "treaty", "pravila",
    "priema", "otchet", "raport", "samoobsled",
)

PDF_OFFICIAL_MARKERS = (
    "министерство", "университет", "академия", "комитет", "комисси", "федеральное государственное",
    "министерство образования", "minister", "ministry", "university", "academy", "committee", "agency",
    "rector", "ректор",
)

PDF_ORG_CONTACT_MARKERS = (
    "контакты", "контактная информация", "координаты для связи", "contact us", "info@", "support@", "sales@",
    "hr@", "pr@", "press@", "marketing@", "university", "университет", "академия", "рбк",
)

PDF_NARRATIVE_ONLY_CATEGORIES = (
    "health_data", "religious_beliefs", "political_beliefs", "race_data", "nationality_data",
    "special_category_other", "email", "phone", "address", "bank_account", "bik", "inn_legal_entity",
)

PDF_LINKABLE_ANCHORS = (
    "person_name", "passport_series", "passport_number", "passport_series_number", "snils", "inn_individual",
    "mrz",
)

HARD_PERSONAL_CATEGORIES = (
    "snils", "passport_series", "passport_number", "passport_series_number", "inn_individual", "bank_card",
    "driver_license", "mrz",
)

PUBLIC_OVERRIDE_BLOCKERS = (
    "snils", "passport_series", "passport_number", "passport_series_number", "bank_card", "driver_license",
    "mrz",
)

JUSTIFIED_PUBLIC_MARKERS = (
    "координаты для связи", "контактные данные ответственных", "структурных подразделений",
    "contact directory", "directory", "public self disclosure", "self disclosure", "public report",
    "публичный отчет", "публичный отчёт", "самообслед", "официальный сайт", "official", "responsible person",
    "ответственный", "ответственных", "университет", "university", "академия", "academy", "институт",
    "institute", "department", "подразделени",
)

PUBLIC_REPORT_MARKERS = (
    "policy", "privacy", "report", "article", "brochure", "news", "протокол", "реестр", "registry",
    "extract", "выписка", "публич", "самообслед", "disclosure",
)

PERSONAL_FORM_MARKERS = (
    "анкета", "anketa", "application", "applicant", "candidate", "заявлен", "соглас", "consent", "доверен",
    "power of attorney", "employee card", "employee profile", "passport", "паспорт", "snils", "снилс", "инн",
    "resume", "curriculum vitae", "personal details",
)

INTERNAL_DOC_MARKERS = (
    "employee", "сотрудник", "кадры", "hr", "personnel", "рабоч", "пропуск", "компенсац", "служеб",
    "доставка оборудования", "delivery", "home-office", "internet reimbursement", "requester", "recipient",
)

CORRESPONDENCE_MARKERS = (
    "subject:", "from:", "to:", "re:", "fw:", "переписка", "писем", "доставка кресла", "сообщение",
)

PERSONAL_EXPORT_PATH_MARKERS = (
    "customers", "customer", "clients", "client", "subscribers", "billing/full", "logistics", "shipping",
    "delivery", "addresses", "physical.parquet",
)

PERSONAL_EXPORT_HEADER_MARKERS = (
    "customer_name", "customer type", "customer_type", "full name", "fio", "фио", "name", "address",
    "destination_address", "phone", "email", "passport", "snils", "inn", "birth",
)

COMPANY_EXPORT_MARKERS = (
    "company", "company_name", "organization", "organisation", "corporate", "contact", "contact_person",
    "contact person", "юридическ",
)

ORG_SUFFIX_MARKERS = (
    " llc", " inc", " corp", " ltd", " and sons", " group", " company", " holdings", " ооо ", " ао ",
    " пао ",
)

ORG_REQUISITE_MARKERS = (
    "инн организации", "legal entity", "юридическое лицо", "расчетный счет", "расчётный счёт", "бик", "kpp",
    "кпп", "operator", "оператор",
)

IMAGE_DOC_MARKERS = (
    "scan", "скан", "паспорт", "passport", "id card", "document image", "удостоверение",
)

NOISE_MARKERS = (
    "window.", "document.", "datalayer", "gtag(", "ym(", "utm_", "session", "token", "cache-control",
    "onclick", "javascript:", "function(", "const ", "let ", " var ", "=>", "{", "}", "return ",
)

WEB_DOC_MARKERS = (
    "meta", "canonical", "viewport", "stylesheet", "generator", "theme-color", "journal",
)

PUBLIC_WEB_MARKERS = (
    "livejournal", "жж", "follow us", "top interesting", "checklist", "applications ios", "android",
    "huawei", "telegram", "twitter", "vkontakte", "user agreement", "comments", "tags", "rss", "atom",
)

PUBLIC_WEB_SUPPRESSED_CATEGORIES = (
    "address", "email", "birth_date", "birth_place", "passport_series", "passport_number",
    "passport_series_number", "driver_license", "mrz", "health_data", "religious_beliefs",
    "political_beliefs", "race_data", "nationality_data", "special_category_other", "fingerprints",
    "iris_pattern", "voice_print", "face_geometry",
)

PUBLIC_DOC_KEYWORDS = (
    "privacy", "privacy policy", "terms", "terms of service", "rules", "cookies", "policy", "политика",
    "cookies", "персональные данные", "обработка персональных данных", "соглашение", "правила",
    "условия использования",
)

LEGAL_MARKERS = (
    "оператор персональных данных", "субъект персональных данных", "consent", "controller", "lawful basis",
    "конфиденциальность", "настоящая политика", "персональных данных",
)

REFERENCE_PATH_MARKERS = (
    "plan", "plans", "product", "products", "catalog", "catalogue", "tariff", "billing", "incident",
    "incidents", "service", "services", "package",
)

REFERENCE_FIELD_MARKERS = (
    "plan", "product", "tariff", "incident", "service", "package", "catalog", "status", "type", "code",
    "sku",
)

PERSONAL_FIELD_MARKERS = (
    "customer_name", "full name", "first name", "last name", "surname", "given name", "destination_address",
    "address", "phone number", "mobile phone", "phone", "email", "snils", "inn", "birth", "date of birth",
    "birthplace", "dob", "фио", "телефон", "адрес",
)

FORM_MARKERS = (
    "заполнить", "заявитель", "подпись", "расшифровка", "паспорт", "passport", "дата рождения",
    "date of birth", "фио", "full name", "first name", "last name", "адрес", "address",
)

OCR_SHORTLIST_MARKERS = (
    "anket", "anketa", "анкет", "zayav", "заяв", "soglas", "соглас", "passport", "паспорт", "snils", "снилс",
    "dms", "дмс", "dover", "довер", "raspis", "расписк", "propusk", "пропуск", "dostav", "достав", "kurier",
    "курьер", "kadry", "кадр", "личн", "consent", "questionnaire", "home_office", "scan", "скан",
    "curriculum vitae", "resume", "cv",
)

OCR_PUBLIC_SKIP_MARKERS = (
    "выгрузки/сайты", "документы партнеров", "privacy", "policy", "terms", "cookies", "report", "отчет",
    "отчёт", "protocol", "протокол", "реестр", "реестров", "выписка", "mediakit", "медиакит", "brochure",
    "presentation", "license", "лиценз", "аккредит", "rules", "правила",
)

HEADER_MARKERS = (
    "фамилия", "фио", "инициалы", "full name", "first name", "last name", "middle name", "given name",
    "surname", "name", "email", "e-mail", "телефон", "telephone", "phone number", "phone", "адрес",
    "address", "дата рождения", "date of birth", "birth", "birthplace", "паспорт", "снилс", "инн", "доход",
    "имущество", "объекты недвижимости", "вид объекта", "площад", "страна",
)
