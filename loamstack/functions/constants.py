"""Fixed values that results depend on."""

from __future__ import annotations

# Thresholds of the phases.
NEAR_JACCARD = 0.85
NEAR_CONTAINMENT = 0.92
SUPERSEDE_SUBJECT = 0.5
SUPERSEDE_BODY_LOW = 0.40
SUPERSEDE_BODY_HIGH = 0.85
CONFLICT_BODY_LOW = 0.25
MERGE_SIMILARITY = 0.50
SUBJECT_TOKENS = 6
LEAD_TOKENS = 3
THEME_RECORDS = 3
THEMES_SHOWN = 8

# Formats.
SECTION_DELIMITER = "\n§\n"
FORMATS = ("sections", "bullets", "paragraphs")

# Limits of one file and its side files, in bytes, entries, pairs and seconds.
MAX_FILE_BYTES = 10_000_000
MAX_SIDE_BYTES = 10_000_000
MAX_PENDING_BYTES = 50_000_000
MAX_JOURNAL_BYTES = 64 * 1024
MAX_ENTRIES = 10_000
MAX_COMPARISONS = 200_000
LOCK_SECONDS = 30.0

# Words that carry no subject, English and Arabic.
STOP_WORDS = tuple((
    "all and are be been being but can did does for from has have her him his how is it its my not our out she that the "
    "their them these they this those use used using was were what when where which who why will with you your "
    "أن أنت أو أي إلى إن التى التي الذى الذي الى ان انت او اي بعد بعض ثم ذالك ذلك على عن عند في قبل قد كان كل كيف لا لقد "
    "لكن لم لماذا لن ما ماذا مع من نحن هذا هذه هم هناك هو هي يكون").split())

# Arabic prefixes and suffixes, in the order they are tried.
ARABIC_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ل", "ك", "س")
ARABIC_SUFFIXES = ("تها", "تهن", "تنا", "تهم", "ية", "ون", "ين", "ان", "ات", "ها", "هن", "هم", "نا", "ة", "ي", "ت", "ن")

# Each stem with its singular and broken plural.
BROKEN_PLURALS = {
    "أدا": ("أداة", "أدوات"), "بيان": ("بيان", "بيانات"), "جدول": ("جداول", "جدول"), "حرف": ("حرف", "حروف"),
    "خبير": ("خبراء", "خبير"), "دول": ("دول", "دولة"), "رابط": ("رابط", "روابط"), "رسال": ("رسائل", "رسالة"),
    "عقد": ("عقد", "عقدة"), "قاعد": ("قاعدة", "قواعد"), "قرار": ("قرار", "قرارات"), "كلم": ("كلمات", "كلمة"),
    "مدين": ("مدن", "مدينة"), "مشروع": ("مشاريع", "مشروع"), "ملف": ("ملف", "ملفات"), "نموذج": ("نماذج", "نموذج"),
    "وظيف": ("وظائف", "وظيفة"), "وكيل": ("وكلاء", "وكيل"),
}
PLURAL_STEMS = {form: stem for stem, forms in BROKEN_PLURALS.items() for form in forms}

# Ranges of scripts that put no space between words, as regular-expression text.
NO_SPACE = r"⺀-鿿㐀-䶿豈-﫿぀-ヿ가-힯฀-๿"
#: Letters, numbers, the underscore and the whole Arabic block.
WORD = r"\p{L}\p{N}_؀-ۿ"
#: White space as Unicode defines it, and the characters that end a line.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"
