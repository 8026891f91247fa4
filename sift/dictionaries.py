"""Default dictionaries, as caller-replaceable small tables.

Every operator that uses a dictionary takes it as a DataFrame (or a list of
rows) argument; the values below are only the defaults. They are the
reference deployment's own word lists, kept verbatim so results match it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values (must equal the reference's for matching results) --------

# Slang token -> formal replacement; "" deletes the token.
SLANG = [
    ("gw", "saya"), ("gue", "saya"), ("gua", "saya"),
    ("lu", "kamu"), ("lo", "kamu"), ("elu", "kamu"),
    ("ga", "tidak"), ("gak", "tidak"), ("nggak", "tidak"), ("ngga", "tidak"),
    ("udah", "sudah"), ("udh", "sudah"),
    ("yg", "yang"), ("dgn", "dengan"), ("utk", "untuk"), ("krn", "karena"),
    ("bgt", "banget"), ("bkn", "bukan"), ("blm", "belum"),
    ("org", "orang"), ("hrs", "harus"), ("bs", "bisa"),
    ("sm", "sama"), ("dr", "dari"), ("tp", "tapi"),
    ("emg", "memang"), ("emang", "memang"),
    ("kyk", "kayak"), ("kayak", "seperti"),
    ("dmn", "dimana"), ("gmn", "bagaimana"), ("gmna", "bagaimana"),
    ("bnyk", "banyak"), ("skrg", "sekarang"), ("trs", "terus"),
    ("lgsg", "langsung"), ("blg", "bilang"), ("ngmg", "ngomong"),
    ("wkwk", ""), ("wkwkwk", ""), ("haha", ""), ("hehe", ""),
    ("anjir", "anjing"), ("anjay", "anjing"),
    ("bokap", "ayah"), ("nyokap", "ibu"),
]

# Emoji -> tag, applied in this order.
EMOJI = [
    ("🔥", "[api]"), ("💀", "[tengkorak]"), ("⚔️", "[pedang]"),
    ("💣", "[bom]"), ("🔫", "[senjata]"), ("🗡️", "[pisau]"),
    ("✊", "[tinju]"), ("👊", "[pukul]"), ("😡", "[marah]"),
    ("🤬", "[marah]"), ("💪", "[kuat]"), ("⚠️", "[peringatan]"),
    ("🚨", "[darurat]"), ("☠️", "[bahaya]"),
]

# Lexicon term, meaning, threat level, note.
LEXICON = [
    ("jihad", "perjuangan", "CONTEXT_DEPENDENT", "makna bervariasi bergantung situasi lapangan"),
    ("istisyhad", "operasi bunuh diri", "HIGH", "istilah pejuang martir sayap kanan"),
    ("thogut", "pemerintah lalim", "MEDIUM", "pelabelan antipati pihak penguasa"),
    ("kafir harbi", "target perlawanan", "HIGH", "konotasi dehumanisasi fatal"),
    ("hijrah", "pindah aliansi", "CONTEXT_DEPENDENT", "penanda reorganisasi atau perpindahan tempat"),
    ("amaliyah", "kegiatan lapangan", "MEDIUM", "sinyal ancaman mobilisasi massa"),
    ("bakar", "hasutan provokasi", "MEDIUM", "seruan kerusuhan fisik"),
    ("gebuk", "hantaman fisik", "MEDIUM", "perintah ancaman penganiayaan"),
    ("sapu bersih", "eliminasi sepihak", "HIGH", "retorika intoleransi dan pembersihan"),
    ("bersihkan", "pembersihan kelompok", "CONTEXT_DEPENDENT", "sinyal pengusiran atau pembasmian"),
    ("ganyang", "binasakan", "HIGH", "pembawaan nada konfrontasi keras"),
    ("usir", "usir paksa", "MEDIUM", "pengusiran terorganisir kelompok minoritas"),
    ("akhi", "saudara kawan", "LOW", "sapaan biasa namun sering menjadi penanda isolasi"),
    ("ikhwan", "asosiasi internal", "CONTEXT_DEPENDENT", "indikasi faksionalisme atau organisasi ekstrem"),
    ("anshor", "penolong pihak luar", "CONTEXT_DEPENDENT", "bermakna ganda sesuai situasi lapangan"),
    ("mujahid", "pejuang tempur", "MEDIUM", "identifikasi personel garis geras"),
    ("malam ini", "tenggat malam", "LOW", "lampu kuning bila dirangkaikan instruksi operasional"),
    ("segera", "gerak cepat", "LOW", "urgensi eskalasi singkat"),
    ("besok pagi", "inisiasi pagi", "LOW", "penanda batas waktu gerakan"),
    ("sudah waktunya", "waktu pelaksanaan", "MEDIUM", "sinyal persiapan mobilisasi matang"),
    ("dizalimi", "perasaan dirugikan", "MEDIUM", "justifikasi untuk retaliasi agresif"),
    ("bangkit", "eskalasi", "CONTEXT_DEPENDENT", "propaganda mobilisasi reaktif"),
    ("perlawanan", "aksi balasan", "CONTEXT_DEPENDENT", "ajakan memberontak terbuka"),
    ("musuh", "target operasi", "MEDIUM", "penanda oposisi tidak kompromi"),
    ("pengkhianat", "desertir", "MEDIUM", "label bagi informan atau pihak kompromis"),
]

# Call-to-action regexes (Python syntax), in order.
ACTION_PATTERNS = [
    r"ayo\s+(kita\s+)?",
    r"mari\s+(kita\s+)?",
    r"wajib\s+",
    r"harus\s+",
    r"saatnya\s+",
    r"jangan\s+diam\s+saja",
    r"bergerak\s*!",
    r"lawan\s*!",
    r"habisi\s*!",
    r"serang\s*!",
    r"turun\s+ke\s+jalan",
]

# Temporal-urgency regexes (Python syntax), in order.
URGENCY_PATTERNS = [
    r"malam\s+ini",
    r"besok\s+(pagi|siang|malam)",
    r"segera",
    r"sekarang\s+juga",
    r"detik\s+ini",
    r"sudah\s+waktunya",
    r"tidak\s+bisa\s+ditunda",
]

# --- end of fixed values ----------------------------------------------------

SLANG_SCHEMA = T.StructType([T.StructField("token", T.StringType()),
                             T.StructField("replacement", T.StringType())])
EMOJI_SCHEMA = T.StructType([T.StructField("emoji", T.StringType()),
                             T.StructField("tag", T.StringType()),
                             T.StructField("ord", T.IntegerType())])
LEXICON_SCHEMA = T.StructType([T.StructField(c, T.StringType())
                               for c in ("term", "meaning", "threat_level", "note")]
                              + [T.StructField("ord", T.IntegerType())])
PATTERN_SCHEMA = T.StructType([T.StructField("pattern", T.StringType()),
                               T.StructField("ord", T.IntegerType())])


def slang_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else SLANG, SLANG_SCHEMA)


def emoji_table(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows if rows is not None else EMOJI
    return spark.createDataFrame([(e, t, i) for i, (e, t) in enumerate(rows)], EMOJI_SCHEMA)


def lexicon_table(spark: SparkSession, rows=None) -> DataFrame:
    rows = rows if rows is not None else LEXICON
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LEXICON_SCHEMA)


def pattern_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(p, i) for i, p in enumerate(rows)], PATTERN_SCHEMA)
