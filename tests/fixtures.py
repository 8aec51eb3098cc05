"""Small tables of our own: a lexicon of hand-written forms, names, pairs, and verified errors."""

from collatura.schemas import ERROR, GOLDEN, LEXICON

# form, lemma, pos, number, gender, case, aspect, voice, tense, rank
FORMS = [
    ("дом", "дом", "NOUN", "sing", "masc", "nomn", None, None, None, 1),
    ("дома", "дом", "NOUN", "sing", "masc", "gent", None, None, None, 1),
    ("дома", "дома", "ADVB", None, None, None, None, None, None, 2),
    ("домам", "дом", "NOUN", "plur", "masc", "datv", None, None, None, 1),
    ("ключ", "ключ", "NOUN", "sing", "masc", "nomn", None, None, None, 1),
    ("ключа", "ключ", "NOUN", "sing", "masc", "gent", None, None, None, 1),
    ("делал", "делать", "VERB", "sing", "masc", None, "impf", "actv", "past", 1),
    ("сделал", "сделать", "VERB", "sing", "masc", None, "perf", "actv", "past", 1),
    ("делали", "делать", "VERB", "plur", None, None, "impf", "actv", "past", 1),
    ("делает", "делать", "VERB", "sing", None, None, "impf", "actv", "pres", 1),
    ("делая", "делать", "GRND", None, None, None, "impf", "actv", None, 1),
    ("быстро", "быстро", "ADVB", None, None, None, None, None, None, 1),
    ("быстрый", "быстрый", "ADJF", "sing", "masc", "nomn", None, None, None, 1),
    ("быстр", "быстрый", "ADJS", "sing", "masc", None, None, None, None, 1),
    ("проводит", "проводить", "VERB", "sing", None, None, "impf", "actv", "pres", 1),
    ("проходит", "проходить", "VERB", "sing", None, None, "impf", "actv", "pres", 1),
    ("иван", "иван", "Name", "sing", "masc", "nomn", None, None, None, 1),
    ("ивана", "иван", "Name", "sing", "masc", "gent", None, None, None, 1),
    ("ивану", "иван", "Name", "sing", "masc", "datv", None, None, None, 1),
    ("красивого", "красивый", "ADJF", "sing", "masc", "gent", None, None, None, 1),
    ("красивово", "красивый", "ADJF", "sing", "masc", "gent", None, None, None, 1),
]

NAMES = [("иван",), ("ивана",), ("аранви",), ("вильгельм",)]
PROTECTED = [("гильдия",)]
PAIRS = [("чо", "что", "typical"), ("щас", "сейчас", "typical"), ("вас", "нас", "typical"), ("он был", "был он", "transposition"), ("виль", "гельм", "split_name")]

#: chapter, time, seconds, type, heard, expected: every one must survive the rules.
GOLDEN_ROWS = [
    ("01", "0:01", 1, "substitution", "вас", "нас", ""),
    ("01", "0:02", 2, "substitution", "ключ", "ключа", ""),
    ("01", "0:03", 3, "substitution", "проводит", "проходит", ""),
    ("01", "0:04", 4, "substitution", "делает", "делал", ""),
    ("01", "0:05", 5, "substitution", "делал", "делая", ""),
    ("01", "0:06", 6, "substitution", "делали", "делал", ""),
    ("01", "0:07", 7, "substitution", "а", "и", ""),
    ("01", "0:08", 8, "deletion", "", "совсем", ""),
    ("01", "0:09", 9, "insertion", "очень", "", ""),
]


def lexicon(spark):
    return spark.createDataFrame(FORMS, LEXICON)


def golden(spark):
    return spark.createDataFrame(GOLDEN_ROWS, GOLDEN)


def errors(spark, rows):
    """Error rows from (type, wrong, correct) or with a context, three minutes apart so that none is a chain."""
    full = [("01", k, 180.0 * k, r[0], r[1], r[2], r[3] if len(r) > 3 else "", 0, "", None) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, ERROR)
