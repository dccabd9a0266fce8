"""What depends on a language: boundaries, units, particles, word lists and patterns, as one swappable record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LangProfile:
    """Patterns are Java regular expressions; lists keep their natural order."""

    name: str
    #: (pattern, replacement) in turn put a line break at each sentence boundary.
    boundaries: tuple[tuple[str, str], ...]
    min_sentence: int
    enumerator: str
    number_unit: str
    letter: str
    heading: str
    drop_line: str
    stop_words: frozenset[str]
    terms: tuple[str, ...]
    particles: tuple[str, ...]
    predicate: str
    form_item: str
    min_predicate: int
    connective: str
    nominal: str
    passive: str
    formal: str
    suffix_word: str
    scaffold_labels: tuple[str, ...]
    scaffold_final: str
    min_letter_ratio: float
    meta: tuple[str, ...]
    clause: str
    blanks: dict[str, str] = field(hash=False)
    protected: tuple[tuple[str, str], ...]
    swaps: tuple[tuple[str, str, str], ...]
    unit_map: dict[str, str] = field(hash=False)
    fabrications: tuple[str, ...]
    off_topic: tuple[str, ...]


# Korean word lists, patterns and messages that results depend on.
_KO_TERMS = (
    "갑상선", "담낭", "전립선", "방광", "신장", "유방", "척추", "관절", "인대",
    "혈관", "신경", "고관절", "슬관절", "견관절", "인공관절", "십자인대",
    "골절", "탈구", "종양", "낭종", "궤양", "협착", "파열", "농양", "감염",
    "출혈", "혈전", "색전증", "마취", "수혈", "봉합", "절제", "이식", "배액관",
    "합병증", "후유증", "부작용", "재발", "불유합", "성대마비", "저칼슘혈증",
)
_KO_STOP = """환자 수술 시술 검사 치료 경우 가능 필요 발생 대한 위해 통해 이후 이전 다음 아래 관련
설명 동의 내용 방법 사항 결과 상태 정도 이상 이하 미만 대해 위한 등의 또는 그리고 하지만 있습니다
없습니다 합니다 됩니다 입니다 병원 의사 의료진 서명 보호자 성명 날짜 기록 확인 이해 질문 답변
본인 가족 담당 예정 시행 실시 있으며 하며 그러나 따라서 대체방법 주의사항"""
_KO_PARTICLES = (
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "에게", "에는",
    "으로", "로", "와", "과", "도", "만", "부터", "까지", "라", "이라",
    "이나", "나", "이며", "며", "이고", "고", "인", "이란", "란",
    "처럼", "보다", "조차", "마저", "밖에", "이라고", "라고",
    "술", "시", "후", "전", "중", "및", "또는",
)
_KO_LABELS = (
    "병록번호", "생년월일", "주민등록", "성명", "환자명", "보호자",
    "진료과", "주치의", "수술명", "시술명", "휴대전화", "집전화",
    "전화번호", "주 소", "주소", "서명", "날인", "작성일", "성별",
    "나이", "동의서", "설명의사", "면허번호", "일 시", "관계",
)
_KO_DROP = (
    r"유\s*무|□|■|☐|☑|병록\s*번호|등록\s*번호|성명|생년월일|성별\s*/?\s*나이|진료과|주치의|"
    r"시행\s*예정|병동|병실|집도의|참여\s*의료진|전문의|전문\s*과목|서명|보호자|"
    r"^\s*\(?\s*[좌우]\s*\)?\s*$|^\s*년\s*월\s*일|환자의\s*현재\s*상태"
)
_KO_UNITS = "주|일|개월|시간|분|년|%|퍼센트|cc|ml|mg|회|명|번|세"
_KO_GUARDED_UNITS = "(?:주|일|개월|달|시간|분|초|년|%|퍼센트|회|번|명|세|박|cc|ml|mg|g|kg|cm|mm)"
_KO_MISSING = r"약\s+(?=정도|가량|이내|이상|이하|동안|쯤)"
_KO_META = (
    r"^아래는", r"물론입니다", r"필요하시?면", r"드릴\s*수\s*있",
    r"원문에?\s*있는\s*모든", r"원문의?\s*모든\s*내용", r"다시\s*(작성|정리)한",
    r"추가\s*내용은?\s*없", r"이해할\s*수\s*있도록\s*(간단|명확)",
    r"^수술\s*동의서\s*\(", r"^\[?.*설명판\)?$", r"도움이\s*되",
)
_KO_SWAPS = (
    ("NEGATE", "있습니다", "없습니다"), ("NEGATE", "없습니다", "있습니다"),
    ("NEGATE", "가능합니다", "불가능합니다"), ("NEGATE", "필요합니다", "필요하지 않습니다"),
    ("NEGATE", "해야 합니다", "하지 않아도 됩니다"),
    ("NEGATE", "됩니다", "되지 않습니다"), ("NEGATE", "합니다", "하지 않습니다"),
    ("SIDE", "좌측", "우측"), ("SIDE", "우측", "좌측"),
    ("SIDE", "왼쪽", "오른쪽"), ("SIDE", "오른쪽", "왼쪽"),
    ("SEVERITY", "드물게", "흔하게"), ("SEVERITY", "드문", "흔한"), ("SEVERITY", "드뭅니다", "흔합니다"),
    ("SEVERITY", "흔하게", "드물게"), ("SEVERITY", "흔히", "드물게"), ("SEVERITY", "흔한", "드문"),
    ("SEVERITY", "간혹", "대부분"), ("SEVERITY", "때때로", "항상"), ("SEVERITY", "거의 없", "매우 많"),
    ("SEVERITY", "낮습니다", "높습니다"), ("SEVERITY", "낮은", "높은"), ("SEVERITY", "낮게", "높게"),
    ("SEVERITY", "높습니다", "낮습니다"), ("SEVERITY", "높은", "낮은"),
    ("SEVERITY", "경미한", "심각한"), ("SEVERITY", "가벼운", "치명적인"), ("SEVERITY", "경한", "중한"),
    ("SEVERITY", "심각한", "경미한"), ("SEVERITY", "심한", "가벼운"),
    ("SEVERITY", "일시적", "영구적"), ("SEVERITY", "영구적", "일시적"),
    ("SEVERITY", "대부분", "일부"), ("SEVERITY", "일부", "대부분"), ("SEVERITY", "매우", "거의"),
)

KO = LangProfile(
    name="ko",
    boundaries=((r"(?<=[다요음임함])\.\s+", "\n"), (r"(?<=[.!?])\s+", "\n")),
    min_sentence=10,
    enumerator=r"^\s*(\d+|[가-힣])\s*[.)]\s*$",
    number_unit=rf"(?<![\d.])(\d{{1,4}})\s*({_KO_UNITS})",
    letter="[가-힣]",
    heading=r"^\s*(\d+)\s*[.．]\s*(.+)$",
    drop_line=_KO_DROP,
    stop_words=frozenset(_KO_STOP.split()),
    terms=_KO_TERMS,
    particles=_KO_PARTICLES,
    predicate=r"(다|요|음|임|함|까|죠)[.\s]*$",
    form_item=r"(무\s*유|유\s*무|미상|해당\s*없음|[:：]\s*$|^\s*[가-힣]{1,6}\s*$)",
    min_predicate=12,
    connective=r"(며|면서|지만|으나|나|고|거나|든지|아서|어서|니까|므로|므로써|도록|더라도|는데|은데|ㄴ데|려면|자면|다면|경우|때문에|위하여|위해)",
    nominal=r"[가-힣]+(함|됨|임|음|기)(?=[\s,.)]|$)",
    passive=r"[가-힣]+(되[어었습니다는]|받[았습니다는]|당[했합]|지[어었습니다는]|혀[졌집])",
    formal=r"(에의|로서의|으로서의|함에|음에|하는 바|에 있어|에 한하여|에 준하여|하여야|되어야|바랍니다)",
    suffix_word=r"[가-힣]{1,4}(증|염|술|양성|성|적|화|법|부위|부|경|관|제|액|압|통|기능|장애|손상|절제|봉합|주입|투여)(?=[\s,.)]|$)",
    scaffold_labels=_KO_LABELS,
    scaffold_final=r"(다|요|음|임|함)[.\s]*$",
    min_letter_ratio=0.35,
    meta=_KO_META,
    clause=r"(?<=[,،;])\s+|(?<=며)\s+|(?<=고)\s+|(?<=거나)\s+",
    blanks={
        "empty_bracket": r"[（(\[〔]\s*[)）\]〕]",
        "rule": r"[_＿]{2,}|\.{4,}|·{4,}|─{2,}",
        "missing_number": _KO_MISSING + r"|(?<![\d])\s(?=(주|일|개월|시간|분|년|%|cc|ml|mg|회)\s*(정도|가량|이내|동안))",
        "missing_noun": r"\s(을|를|이|가|의|은|는|에|와|과)\s",
        "empty_field": r"[:：]\s*$",
    },
    protected=(
        ("N", r"\d{1,4}\s*박\s*\d{1,4}\s*일"),
        ("N", rf"\d{{1,4}}\s*[~∼\-–]\s*\d{{1,4}}\s*{_KO_GUARDED_UNITS}"),
        ("N", rf"\d{{1,4}}\s*{_KO_GUARDED_UNITS}"),
        ("B", r"\[\s*미기재\s*\]"),
        ("B", r"[（(\[〔]\s{2,}[)）\]〕]"),
        ("B", r"[（(\[〔]\s*[)）\]〕]"),
        ("B", r"[_＿]{2,}"),
        ("B", r"\.{4,}"),
        ("B", _KO_MISSING),
    ),
    swaps=_KO_SWAPS,
    unit_map={"주": "개월", "일": "주", "시간": "일", "분": "시간", "개월": "년"},
    fabrications=(
        "또한 이 수술은 약 1시간 정도 소요됩니다.",
        "또한 이 수술의 성공률은 99% 이상입니다.",
        "또한 수술 후 3일째부터 정상 식사가 가능합니다.",
        "또한 이 시술은 건강보험이 전액 적용됩니다.",
    ),
    off_topic=(
        "오늘 서울의 최고 기온은 28도이며 오후 늦게 비가 내리겠습니다.",
        "이 제품의 보증 기간은 구매일로부터 2년이며 소모품은 제외됩니다.",
        "다음 정기 주주총회는 본사 대회의실에서 개최될 예정입니다.",
    ),
)

LATIN = LangProfile(
    name="latin",
    boundaries=((r"([.!?])\s+", "$1\n"),),
    min_sentence=10,
    enumerator=r"^\s*(\d+|[A-Za-z])\s*[.)]\s*$",
    number_unit=r"(?<![\d.])(\d{1,4})\s*(%|days|weeks|months|years|hours|min|mg|ml|cm|kg)",
    letter="[A-Za-zÀ-ÖØ-öø-ÿ]",
    heading=r"^\s*(\d+)\s*[.]\s*(.+)$",
    drop_line=r"^\s*(Date|Name|Signature)\s*:?\s*$",
    stop_words=frozenset("the a an and or of to in is was are were be for with that this on as at by it from der die das und ist den von zu le la les des et un une est du el los las y en que de".split()),
    terms=("tion", "ment", "heit", "keit", "able", "ing"),
    particles=("s", "es", "ed", "ing"),
    predicate=r"[.!?]\s*$",
    form_item=r"(:\s*$|^\s*\w{1,6}\s*$)",
    min_predicate=30,
    connective=r"\b(and|or|but|und|oder|aber|et|ou|mais|y|o|pero)\b",
    nominal=r"\w+(tion|ment|heit|keit)\b",
    passive=r"\b(is|are|was|were|be)\s+\w+ed\b",
    formal=r"\b(shall|hereby|thereof|therein)\b",
    suffix_word=r"\w+(tion|ment|ness|heit|keit)\b",
    scaffold_labels=("name", "date", "address", "email", "phone", "license"),
    scaffold_final=r"[.!?]\s*$",
    min_letter_ratio=0.5,
    meta=(r"^Sure", r"^Here is", r"hope this helps", r"let me know"),
    clause=r"(?<=[,;])\s+",
    blanks={"empty_bracket": r"[(\[]\s*[)\]]", "rule": r"_{2,}|\.{4,}", "empty_field": r":\s*$"},
    protected=(("N", r"\d{1,4}\s*[~-]\s*\d{1,4}"), ("N", r"\d+"), ("B", r"[(\[]\s*[)\]]"), ("B", r"_{2,}"), ("B", r"\.{4,}")),
    swaps=(("NEGATE", " is ", " is not "), ("NEGATE", " are ", " are not "), ("SIDE", "left", "right"), ("SIDE", "right", "left"), ("SEVERITY", "low", "high"), ("SEVERITY", "high", "low")),
    unit_map={"days": "weeks", "weeks": "months", "hours": "days", "min": "hours", "months": "years"},
    fabrications=("Also, this takes about 1 hours.",),
    off_topic=("Tomorrow will be sunny with light winds from the west.", "The warranty lasts two years from the date of purchase."),
)
