"""Tables, thresholds and wordings that results depend on."""

FIRST_LETTER = 0x10A60
#: Names, Arabic letters, Arabic names and transliterations of the 29 letters, in code point order.
LETTER_NAMES = (
    "HE LAMEDH HETH MEM QOPH WAW SHIN RESH BETH TAW SAT KAPH NUN KHETH SADHE SAMEKH FE ALEF AYN DHADHE GIMEL DALETH GHAYN TETH ZAYN DHALETH YODH THAW THETH"
).split()
ARABIC_LETTERS = "هلحمقوشربتسكنخصسفاعضجدغطزذيثظ"
ARABIC_NAMES = "هاء لام حاء ميم قاف واو شين راء باء تاء سين كاف نون خاء صاد سامخ فاء ألف عين ضاد جيم دال غين طاء زاي ذال ياء ثاء ظاء".split()
TRANSLITERATION = "h l ḥ m q w s² r b t s¹ k n ḫ ṣ s³ f ʾ ʿ ḍ g d ġ ṭ z ḏ y ṯ ẓ".split()
LETTERS = [chr(FIRST_LETTER + i) for i in range(29)]
SEPARATOR_CHAR = chr(0x10A7D)
BAR = "|"
#: Numeral labels: value, Arabic digits, Arabic name.
NUMERALS = {
    "NUM_1": (1, "١", "واحد"), "NUM_2": (2, "٢", "اثنان"), "NUM_3": (3, "٣", "ثلاثة"), "NUM_4": (4, "٤", "أربعة"), "NUM_5": (5, "٥", "خمسة"),
    "NUM_6": (6, "٦", "ستة"), "NUM_10": (10, "١٠", "عشرة"), "NUM_50": (50, "٥٠", "خمسون"), "NUM_100": (100, "١٠٠", "مائة"), "NUM_1000": (1000, "١٠٠٠", "ألف"),
}
#: Hard look-alike pairs of letters, and groups of like shapes of letters and numerals, as labels have them.
HARD_PAIRS = [("𐩩", "𐩯"), ("𐩬", "𐩱"), ("𐩥", "𐩲"), ("𐩨", "𐩴"), ("𐩠", "𐩡"), ("𐩫", "𐩬"), ("𐩳", "𐩷"), ("𐩨", "𐩷"), ("𐩨", "𐩳")]
SHAPE_GROUPS = [
    ["NUM_1", "𐩠", "𐩡", "𐩬", "𐩱"],
    ["NUM_2", "NUM_3", "NUM_4", "NUM_5", "NUM_6"],
    ["NUM_10", "𐩥", "𐩲", "𐩶"],
    ["𐩣", "𐩨", "𐩩", "𐩯", "𐩴"],
    ["NUM_50", "𐩤", "𐩫", "𐩬", "𐩱", "𐩴"],
    ["𐩥", "𐩷", "𐩸", "𐩹"],
    ["𐩠", "𐩨", "𐩴", "𐩵", "𐩹", "𐩺"],
    ["𐩧", "𐩺", "𐩻", "𐩼"],
    ["𐩦", "𐩩", "𐩪", "𐩯"],
    ["𐩥", "𐩧", "𐩰"],
    ["𐩢", "𐩭", "𐩮"],
    ["NUM_100", "NUM_1000"],
]

NO_PREVIEW, ELLIPSIS = "—", "…"
DEFAULT_TITLE = "نص محلَّل"
PREVIEW_UNITS, LIST_UNITS, LINK_UNITS, TITLE_UNITS = 80, 72, 40, 56
LINK_MILLIS = 180_000
MAX_UPLOAD = 12 * 1024 * 1024
LIST_DEFAULT, LIST_CAP = 50, 100
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
JOB_TTL_MINUTES, JOB_CAP = 30, 100
ATTACHMENTS_CAP, LOCAL_CAP, RECENT = 8, 40, 5
STATUS_LABELS = {"documented": "موثّق", "archived": "المحفوظات", "local": "على الجهاز"}
SCAN_STATUS, DOCUMENTATION_STATUS = "analyzed", "under_review"
STORED_MARK = "[stored-in-storage]"
UNTITLED = "نقش بدون عنوان"
DOCUMENT_TYPES, DOCUMENT_SUFFIXES = ("pdf", "msword", "wordprocessingml", "text/plain"), (".pdf", ".doc", ".docx", ".txt")
#: Signs and names by which labels give a letter, and letters with a round body.
LABELS_OF = {"mem": ("𐩣", "MEM"), "heth": ("𐩢", "HETH", "HA"), "beth": ("𐩨", "BETH", "BA")}
ROUND_LETTERS = ("𐩥", "𐩲", "𐩧")
WAW, AYN, TETH, DHADHE, BETH, GIMEL = "𐩥", "𐩲", "𐩷", "𐩳", "𐩨", "𐩴"
