"""Visually identical text in different characters: the confusables skeleton (problem 10).

A text's skeleton is: decompose, drop what is invisible, replace every character by the
prototype it is drawn like, decompose again. Two texts look the same exactly if their
skeletons are equal. Letter case, accents, raised and circled digits, punctuation and
line ends stay; every kind of space becomes one blank; a joiner between two pictographs
is kept, since it changes what is drawn.

Look-alike table. Three parts: fixed pairs of letters and signs (`PROTOTYPES`); what the
character database gives by rule (full and half width forms, mathematical letters,
ligatures, digraphs and roman numerals with prototypes of several characters, kinds of
space, invisible characters); and, as a parameter, a file in the format of the published
confusables table (`source ; target ; type`, code points in hexadecimal), whose entries
come on top. Entries between two plain ASCII characters, or from one plain ASCII character
to several, are not taken from a file: `0`/`O`, `1`/`l`/`I` and `rn`/`m` look different.
The table is built once on the driver (a few thousand entries) and broadcast.

Cost: one Arrow pass over the texts (plain ASCII text is its own skeleton), then only
(id, 128-bit key, text hash) is shuffled. A look with many texts is joined with itself in
salted blocks of about `HOT` rows; `look_classes` gives the same without pairs.

Defined results: a null text has a null skeleton and joins no group; texts without a
visible character join no group; exact copies are members of a group, never a pair.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import ensure_checkpoint_dir, ship_package

# Characters and the prototype each is drawn like (look-alike letters and signs).
PROTOTYPES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Greek and Cyrillic letters drawn like each other
    "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κ", "є": "ε", "ф": "φ", "т": "τ", "Ѳ": "Θ", "ѳ": "θ",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B",
    # Other scripts and Latin variants
    "ᴄ": "c", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɩ": "i",
    "Ս": "U", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "Լ": "L", "ɑ": "a", "ɡ": "g", "ı": "i", "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Numerals drawn as letters
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    # Signs
    "‐": "-", "‑": "-", "․": ".", "‚": ",", "∶": ":", "꞉": ":", "։": ":", "⁄": "/", "∕": "/", "∣": "|", "ǀ": "|", "ǃ": "!", "µ": "μ",
}
# Invisible characters outside the format category, and visible ones inside it.
EXTRA_INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
VISIBLE_FORMATS = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}
HOT = 2000  # rows of a look in one block
JOINER = "‍"
_PICTOGRAPH = "←-⇿⌀-⏿☀-➿⬀-⯿\U0001f000-\U0001faff"
_LOOSE_JOINER = re.compile(f"(?<![{_PICTOGRAPH}]){JOINER}|{JOINER}(?![{_PICTOGRAPH}])")


def read_confusables(path: str) -> dict[str, str]:
    """Entries of a table in the published format that do not merge plain ASCII characters."""
    out = {}
    for line in Path(path).read_text("utf-8-sig").splitlines():
        parts = [x.strip() for x in line.split("#", 1)[0].split(";")]
        if len(parts) >= 2 and parts[0]:
            source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
            if len(source) == 1 and not source.isascii():
                out[source] = target
    return out


@lru_cache(maxsize=4)
def replacements(path: str | None = None) -> dict[int, str | None]:
    """Character to prototype: what the character database gives by rule, the fixed look-alikes, a file's entries."""
    table: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" and cp not in VISIBLE_FORMATS and ch != JOINER:
            table[cp] = None
        elif (d := unicodedata.decomposition(ch)).startswith(("<wide>", "<narrow>", "<font>")):
            table[cp] = "".join(chr(int(x, 16)) for x in d.split()[1:])
        elif d.startswith("<compat>") and (kind == "Nl" or unicodedata.name(ch, "").startswith("LATIN ")):
            table[cp] = unicodedata.normalize("NFKC", ch)  # ligatures, digraphs, roman numerals
    table |= {ord(k): v for k, v in PROTOTYPES.items()}
    table.update(dict.fromkeys(EXTRA_INVISIBLE))
    if path:
        table |= {ord(k): v for k, v in read_confusables(path).items()}
    return table


def skeleton(text: str | None, table: dict[int, str | None] | None = None) -> str | None:
    """The form that all texts looking like this one share."""
    if text is None or text.isascii():
        return text
    t = replacements() if table is None else table
    s = unicodedata.normalize("NFD", text).translate(t)
    s = unicodedata.normalize("NFD", s).translate(t)  # prototypes of wide forms may be look-alikes themselves
    while JOINER in s and (u := _LOOSE_JOINER.sub("", s)) != s:
        s = u
    return unicodedata.normalize("NFD", s)


def _skeletons(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column is the text; its skeleton takes its place."""
        table = shared.value
        for b in batches:
            made = pa.array([skeleton(x, table) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "skeleton"])

    return run


def _mapped(df: DataFrame, schema: str, path: str | None) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(_skeletons(df.sparkSession.sparkContext.broadcast(replacements(path))), schema)


def consistent_texts(docs: DataFrame, confusables: str | None = None) -> DataFrame:
    """(doc_id, skeleton) of every document."""
    return _mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, skeleton string", confusables)


def look_keys(docs: DataFrame, confusables: str | None = None) -> DataFrame:
    """(doc_id, look, form): 128-bit key of the skeleton, hash of the text; only texts with a visible character."""
    s = _mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("form"), "text"), "doc_id bigint, form bigint, skeleton string", confusables)
    return s.where(F.col("skeleton").isNotNull() & F.col("skeleton").rlike(r"[^\s\x00-\x1f\x7f-\x9f‍]")).select("doc_id", F.md5("skeleton").alias("look"), "form")


def _varied(docs: DataFrame) -> DataFrame:
    """Rows of the looks that come in at least two different texts."""
    ensure_checkpoint_dir(docs.sparkSession)
    keys = look_keys(docs).checkpoint()  # the texts are normalised once; both uses below read the small keys
    several = keys.groupBy("look").agg(F.min("form").alias("a"), F.max("form").alias("z")).where("a <> z").select("look")
    return keys.join(several, "look", "left_semi")


def same_look_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents with different texts that look the same."""
    v = _varied(docs).checkpoint()
    a, b = v.select("look", F.col("doc_id").alias("doc_id_a"), F.col("form").alias("fa")), v.select("look", F.col("doc_id").alias("doc_id_b"), F.col("form").alias("fb"))
    large = v.groupBy("look").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("look", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")).checkpoint()
    if large.isEmpty():
        both = a.join(b, "look")
    else:
        both = a.join(large, "look", "left_anti").join(b, "look")
        cut = b.join(large, "look").withColumn("block", F.pmod(F.xxhash64("doc_id_b"), F.col("blocks")).cast("int")).drop("blocks")
        many = a.join(large, "look").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        both = both.unionByName(many.join(cut, ["look", "block"]).drop("block"))
    return both.where("doc_id_a < doc_id_b AND fa <> fb").select("doc_id_a", "doc_id_b")


def look_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, texts): one row per document of a varied look; class_id is its smallest doc_id."""
    v = _varied(docs)
    head = v.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.countDistinct("form").alias("texts"))
    return v.join(head, "look").select("doc_id", "class_id", "texts")
