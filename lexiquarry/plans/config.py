"""Lexicons, weights and limits as data.

``SERVICE`` has the vocabulary of the regulations that the engine answers questions about; other corpora
take another ``Config``.  All numbers and words below are fixed values: they define results.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Strategy:
    code: str
    facts: float
    tables: float
    rows: float
    blocks: float
    documents: int = 2

    def weight(self, branch: str) -> float:
        return {"legal_fact": self.facts, "table": self.tables, "table_row": self.rows, "block": self.blocks}[branch]


STRATEGIES = {
    "documents": Strategy("documents_priority", 1.10, 1.30, 1.45, 0.65, documents=1),
    "deadline": Strategy("deadlines_priority", 1.25, 1.10, 1.10, 0.90, documents=1),
    "rejection": Strategy("rejection_priority", 1.25, 1.00, 1.00, 1.10),
    "form": Strategy("forms_priority", 0.00, 1.30, 1.20, 0.90, documents=1),
    "eligibility": Strategy("eligibility_priority", 1.30, 0.95, 1.00, 1.10),
    "procedure": Strategy("procedure_balanced", 1.0, 1.0, 1.0, 1.0),
    "other": Strategy("balanced_default", 1.0, 1.0, 1.0, 1.0),
}
INTENTS = ("documents", "deadline", "rejection", "form", "eligibility", "procedure", "appeal", "amount", "contacts", "status", "definition", "legal_basis", "other")
BRANCHES = ("legal_fact", "table_row", "table", "block")
TOP_K = {"legal_fact": 10, "table": 10, "table_row": 12, "block": 12}
FINAL_TOP_K = 12
SQL_TERMS = 6
TERM_WEIGHT = {"legal_fact": 0.35, "table": 0.40, "table_row": 0.45, "block": 0.35}
TYPE_FACTOR = {"table_row": 1.45, "legal_fact": 1.20, "table": 1.05, "block": 0.85}
TYPE_RANK = {"legal_fact": 4, "table_row": 3, "table": 2, "block": 1}

FACT_TYPES = {
    "documents": ("required_documents", "documents"),
    "deadline": ("deadline", "review_period", "payment_deadline"),
    "rejection": ("rejection_reason", "grounds_for_refusal"),
    "eligibility": ("eligibility", "condition", "recipient_category"),
}
BOOSTED_TABLE_TYPES = ("eligibility_table", "documents_table", "deadline_table", "form_table")
BLOCK_TYPES = {"procedure": (("paragraph", "list", "heading"), 0.20), "appeal": (("paragraph", "list", "heading"), 0.20)}
OTHER_BLOCK_TYPES = (("paragraph", "list"), 0.10)


@dataclass(frozen=True)
class Config:
    stop_words: tuple[str, ...]
    short_words: tuple[str, ...] = ()
    expansion: dict[str, tuple[str, ...]] = field(default_factory=dict)
    channels: tuple[tuple[str, tuple[str, ...]], ...] = ()
    channel_matches: dict[str, tuple[str, ...]] = field(default_factory=dict)
    profile_markers: tuple[str, ...] = ()
    question_kinds: tuple[tuple[str, tuple[str, ...]], ...] = ()
    candidate_kinds: tuple[tuple[str, tuple[str, ...]], ...] = ()
    column_hints: dict[str, tuple[str, ...]] = field(default_factory=dict)
    temporal: tuple[str, ...] = ()
    temporal_units: tuple[str, ...] = ()
    documents_anchor: tuple[str, ...] = ()
    double_anchor: tuple[str, ...] = ()
    required_documents: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    service_documents: tuple[str, ...] = ()
    real_documents: tuple[str, ...] = ()
    service_deadlines: tuple[str, ...] = ()
    header_words: tuple[str, ...] = ()
    header_exact: tuple[str, ...] = ()
    deadline_noise_types: tuple[str, ...] = ()
    refusal_texts: tuple[str, ...] = ()
    rejection: tuple[str, ...] = ()
    eligibility: tuple[str, ...] = ()
    notification_stem: str = "\0"
    monthly: tuple[str, ...] = ()
    decision_phrase: str = "\0"


SERVICE = Config(
    stop_words=("в", "во", "на", "по", "о", "об", "от", "до", "за", "для", "и", "или", "а", "но", "как", "какой", "какие", "каким", "какая", "каких", "когда", "где", "кто", "что", "это", "при", "ли", "из"),
    short_words=("едв",),
    expansion={
        "едв": ("едв", "ежемесячной денежной выплаты", "ежемесячная денежная выплата", "денежной выплаты"),
        "deadline": ("срок", "сроки", "рабочих дней", "календарных дней", "в течение", "не позднее", "дней"),
        "deadline:decision": ("срок принятия решения", "срок рассмотрения", "рассмотрения заявления", "принятия решения", "решение о предоставлении", "решение принимается"),
        "deadline:notification": ("срок уведомления", "уведомление", "уведомления о решении", "направляет уведомление", "направления уведомления", "уведомляет", "сообщение о решении"),
        "deadline:payment": ("срок выплаты", "выплата", "выплачивает", "ежемесячно", "не позднее 26-го числа", "26-го числа", "26 числа"),
        "deadline:other": ("срок предоставления", "срок предоставления государственной услуги", "максимальный срок"),
        "documents": ("документы", "перечень документов", "необходимые документы", "документов необходимых", "представляемые документы", "документы представляемые заявителем", "к заявлению", "заявление", "заявителем", "прилагаемые документы", "предоставления государственной услуги", "наименование документа", "документы необходимые для предоставления государственной услуги"),
        "documents:epgu": ("епгу", "госуслуги", "единый портал", "посредством епгу", "электронной подаче", "в электронной форме", "электронный образ документа", "сведения о документе", "единого портала"),
        "documents:regional_portal": ("рпгу", "краевой портал", "региональный портал", "посредством краевого портала", "электронной подаче", "при электронной подаче посредством рпгу", "электронный образ документа", "сведения о документе"),
        "documents:in_person": ("лично", "личной подаче", "личном обращении", "при личной подаче", "через представителя", "по доверенности", "через социального работника"),
        "documents:post": ("почтой", "почтовым отправлением", "по почте"),
        "documents:mfc": ("мфц", "через мфц"),
        "rejection": ("отказ", "основания отказа", "причины отказа", "решение об отказе", "может быть отказано", "отказывается в предоставлении", "отказывается в назначении", "принимается решение об отказе", "непредставление документов", "недостоверные сведения", "отсутствие права"),
        "eligibility": ("имеет право", "право на едв", "право на получение", "категории граждан", "категории заявителей", "заявитель", "получатели", "предоставляется", "предоставляется заявителям", "условия предоставления", "при наличии права"),
        "procedure": ("порядок", "порядок предоставления", "процедура", "последовательность", "предоставление услуги", "назначение", "назначается", "рассмотрение заявления", "принятие решения"),
    },
    channels=(
        ("epgu", ("епгу", "госуслуг", "единый портал")),
        ("regional_portal", ("рпгу", "краевой портал", "региональный портал")),
        ("in_person", ("лично", "личный прием", "личном обращении", "личной подаче", "по доверенности", "через представителя")),
        ("post", ("почтой", "почтов", "почтовым отправлением", "по почте")),
        ("mfc", ("мфц",)),
    ),
    channel_matches={
        "epgu": ("епгу", "посредством епгу", "электронной подаче", "в электронной форме", "электронный образ документа", "единого портала", "сведения о документе"),
        "regional_portal": ("краевой портал", "посредством краевого портала", "электронной подаче", "в электронной форме", "электронный образ документа", "посредством рпгу", "сведения о документе"),
        "in_person": ("лично", "при личной подаче", "личном обращении", "через представителя", "по доверенности", "через социального работника"),
        "post": ("почтой", "почтовым отправлением", "по почте"),
        "mfc": ("мфц", "через мфц"),
    },
    profile_markers=("какие документы", "какие нужны документы", "перечень документов", "необходимые документы", "что приложить", "что предоставить", "какие документы нужны", "какие документы нужны для", "документы для получения", "документы для предоставления услуги"),
    question_kinds=(
        ("notification", ("уведомления", "уведомить", "уведомление", "направления уведомления", "информирования", "сообщения о решении")),
        ("payment", ("выплаты", "выплата", "выплачивается", "перечисления", "перечисление", "зачисления", "зачисление")),
        ("decision", ("принятия решения", "принятие решения", "рассмотрения заявления", "рассмотрение заявления", "регистрации заявления", "назначении", "назначение")),
    ),
    candidate_kinds=(
        ("decision", ("принятия решения", "принятие решения", "решение о предоставлении", "решение о назначении", "рассмотрения заявления", "рассмотрение заявления", "регистрации заявления", "назначении", "назначение")),
        ("notification", ("уведомления", "уведомление", "направляет уведомление", "направления уведомления", "уведомить", "информирования", "сообщения о решении")),
        ("payment", ("выплаты", "выплата", "выплачивается", "перечисления", "перечисление", "зачисления", "зачисление", "26-го числа", "26 числа")),
    ),
    column_hints={
        "documents_base": ("document_name", "наименование документа"),
        "deadline": ("deadline_value", "срок", "сроки", "рабочих дней", "календарных дней"),
        "deadline:decision": ("срок принятия решения", "срок рассмотрения", "решение о предоставлении"),
        "deadline:notification": ("срок уведомления", "уведомление", "направления уведомления"),
        "deadline:payment": ("срок выплаты", "выплата", "не позднее 26-го числа"),
        "deadline:other": ("срок предоставления", "срок предоставления государственной услуги", "максимальный срок"),
        "channel:epgu": ("document_name", "наименование документа", "epgu_submission", "при электронной подаче посредством епгу", "электронной подаче", "единого портала"),
        "channel:regional_portal": ("document_name", "наименование документа", "regional_portal_submission", "при электронной подаче посредством краевого портала", "электронной подаче", "краевого портала", "при электронной подаче посредством рпгу"),
        "channel:in_person": ("document_name", "наименование документа", "in_person_submission", "при личной подаче", "лично", "через представителя", "по доверенности", "через социального работника"),
        "channel:post": ("document_name", "наименование документа", "post_submission", "почтовым отправлением", "по почте"),
        "channel:mfc": ("document_name", "наименование документа", "mfc_submission", "через мфц", "мфц"),
    },
    temporal=("в течение", "не позднее", "не более", "рабочих дней", "календарных дней", "26-го числа", "26 числа"),
    temporal_units=("дней", "дня", "числа"),
    documents_anchor=("документы", "перечень документов", "необходимые документы", "документов необходимых", "заявление", "заявителем", "представляемые документы", "прилагаемые документы", "наименование документа", "электронный образ документа", "сведения о документе", "таблица 2", "приложение n 2", "приложения n 2"),
    double_anchor=("наименование документа",),
    required_documents=("перечень документов", "необходимые документы", "документы необходимые для предоставления государственной услуги", "документы представляемые заявителем", "наименование документа", "представляется электронный образ документа", "сведения о документе", "таблица 2", "приложение n 2", "приложения n 2"),
    abbreviations=("условных обозначений", "сокращений", "условных обозначений и сокращений", "перечень условных обозначений"),
    service_documents=("исчерпывающий перечень документов", "способ подачи в уполномоченное учреждение"),
    real_documents=("запрос заявление", "паспорт", "документ подтверждающий полномочия", "вступившее в законную силу решение суда", "справка"),
    service_deadlines=("срок", "сроки", "срок предоставления", "срок предоставления государственной услуги", "максимальный срок", "рабочих дней", "календарных дней"),
    header_words=("министерство", "правительство", "красноярского края", "российской федерации", "постановление", "приказ", "утвержден", "утверждён", "административного регламента", "государственной услуги по предоставлению", "министр"),
    header_exact=("министр", "и.л.пастухова", "красноярского края"),
    deadline_noise_types=("refusal_reasons", "rejection_reasons", "documents", "identifiers", "categories", "applicant_categories", "glossary", "abbreviations", "aliases"),
    refusal_texts=("отказа в предоставлении", "перечень оснований"),
    rejection=("основания отказа", "отказа в предоставлении", "отказа в приеме", "непредставление документов", "недостоверные сведения"),
    eligibility=("имеет право", "категории заявителей", "заявителями являются", "право на получение"),
    notification_stem="уведом",
    monthly=("26-го числа", "26 числа", "ежемесячно"),
    decision_phrase="решение о предоставлении",
)

#: For the driver's tables: words that their four languages have.
DRIVER = Config(
    stop_words=("the", "and", "der", "die", "und", "les", "des", "que"),
    expansion={"documents": ("order", "urgent"), "deadline": ("tion", "ent")},
    temporal=("not later", "within"), temporal_units=("tion", "keit", "ment"),
    documents_anchor=("the", "tion", "en"), double_anchor=("tion",),
    question_kinds=(("notification", ("sich",)), ("payment", ("pour",)), ("decision", ("that",))),
    candidate_kinds=(("decision", ("that", "this")), ("notification", ("sich", "nicht")), ("payment", ("pour", "avec", "para"))),
    header_words=("licen", "http"), header_exact=("untitled",),
    rejection=("non",), eligibility=("able",), abbreviations=("@",), deadline_noise_types=("refusal_reasons", "documents"),
    required_documents=("order", "urgent", "high"), refusal_texts=("not specified",),
)
