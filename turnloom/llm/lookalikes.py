"""One form for texts that look the same: a look-alike map, Unicode collation in SQL, a canonical member."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.conversations import is_blank
from turnloom.llm.expand import between, blocks_of, within
from turnloom.operators.keys import having, looked_up
from turnloom.session import cut_lineage

#: Letters of other scripts beside the Latin ones they look like, pair by pair.
LOOKALIKES = (
    "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X ο o ν v ι ı ρ p κ ĸ α ɑ υ ʋ ϲ c Ϲ C ϳ j γ ɣ "  # Greek
    "А A В B Е E Ѕ S І I Ј J К K М M Н H О O Р P С C Т T У Y Х X Ԛ Q Ԝ W Ү Y Һ h Ԍ G Ӏ I "  # Cyrillic capitals
    "а a с c ԁ d е e һ h і i ј j ӏ l о o р p ԛ q ѕ s ѵ v ԝ w х x у y ү y к ĸ г r "  # Cyrillic small letters
    "օ o Օ O ս u ո n հ h ց g զ q Տ S Լ L "  # Armenian
    "Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮐ G Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꮢ R Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z"  # Cherokee
)
#: Look-alikes whose small letter in the other script isn't one of the basic alphabet; they
#: only make the two scripts meet, so they are left out of the map.
_SKIPPED = set("ıĸɑʋɣ")
#: Characters that are several others set together.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj"}
#: Invisible characters beside those of the categories Cf and Cc.
_INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))


@lru_cache(maxsize=1)
def character_map() -> tuple[str, str, dict[str, str]]:
    """The two arguments of translate() (characters and what they become; those without a partner vanish), and the characters that become several.

    Made from Unicode's own data: invisible ones go, kinds of space become a space, full-width and half-width
    forms their usual width, letters of another script the Latin letter they look like, with their accents
    kept. Accents, case, digits, superscripts and enclosed numbers aren't touched. Line ends and tabs stay.
    """
    pairs = LOOKALIKES.split()
    letters = {a: b for a, b in zip(pairs[::2], pairs[1::2]) if b not in _SKIPPED}
    change: dict[str, str] = {}
    gone = [chr(c) for c in range(0x20) if chr(c) not in "\t\n\r\x0b\x0c"] + ["\x7f"]
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        if category == "Cf" or c in _INVISIBLE or 0xE0100 <= code <= 0xE01EF or category == "Cc" and c != "\x85":
            gone.append(c)
        elif category == "Zs":
            change[c] = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")):
            change[c] = unicodedata.normalize("NFKC", c)
        elif c in letters:
            change[c] = letters[c]
        elif (parts := unicodedata.normalize("NFD", c))[0] in letters:
            change[c] = unicodedata.normalize("NFC", letters[parts[0]] + parts[1:])
    several = LIGATURES | {a: b for a, b in change.items() if len(b) > 1}
    change = {a: b for a, b in change.items() if len(b) == 1}
    return "".join(change) + "".join(gone), "".join(change.values()), several


def mapped(text: Column) -> Column:
    """text with look-alikes, widths, spaces, ligatures and invisible characters in one form; accents may still be composed or not."""
    before, after, several = character_map()
    # a fold over a constant list: nested calls would make one method too large for the JVM to compile
    rules = F.array(*[F.struct(F.lit(one).alias("one"), F.lit(many).alias("many")) for one, many in several.items()])
    expanded = F.aggregate(rules, text, lambda t, r: F.replace(t, r["one"], r["many"]))
    plain = ~text.rlike(r"[^\t\n\x0b\x0c\r -~]")
    # looked up in a table: a class of that many characters is tried one by one
    holds_several = F.translate(text, "".join(several), "") != text
    return F.when(plain, text).otherwise(F.translate(F.when(holds_several, expanded).otherwise(text), before, after))


def composed(text: Column) -> Column:
    """The exact form of mapped text: accents composed as Unicode's canonical form has them."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in s], dtype=object)

    return form(text)


def _id(text: Column) -> Column:
    """A digest that stands for a text where only equality counts."""
    return F.md5(text)


@lru_cache(maxsize=1)
def _single() -> tuple[str, str]:
    """Characters that canonical composition turns into one other, which composes no further: ASCII and ideographs."""
    pairs = [(c, n) for c in map(chr, range(0x80, sys.maxunicode + 1)) if len(n := unicodedata.normalize("NFC", c)) == 1 and n != c and (n.isascii() or "\u4e00" <= n <= "\u9fff")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def skeleton(text: Column) -> Column:
    """A hash of what no composition changes in mapped text: ASCII that bears no mark, and ideographs.

    Texts that look the same have the same skeleton; only texts that share one with a different text go on
    to the collation, so the others are never shuffled.
    """
    before, after = _single()
    bare = F.regexp_replace(F.translate(text, before, after), r"[\x00-\x7F]?\p{M}+|[^\x00-\x7F\u4E00-\u9FFF]+", "")
    return F.xxhash64(F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, raw, skeleton) of each document with visible text: all that most of them ever contribute. Written once."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).where(~is_blank(F.col("text")))
    return cut_lineage(rows.select("doc_id", _id(F.col("text")).alias("raw"), skeleton(mapped(F.col("text"))).alias("skeleton")))


def members_of(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, text, exact, form) of the distinct texts that may look like another distinct text; known: digests(documents).

    exact is a digest of the composed form, form what is collated. One document of each text is read again.
    """
    texts = known.groupBy("skeleton", "raw").agg(F.min("doc_id").alias("doc_id"))
    several = texts.groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("skeleton")
    asked = cut_lineage(texts.join(several, "skeleton").select("doc_id"))
    near = having(documents.select("doc_id", "text"), asked, "doc_id").where("text is not null")
    distinct = near.select(_id(F.col("text")).alias("raw"), "text", mapped(F.col("text")).alias("form")).dropDuplicates(["raw"])
    # marks in another order are canonically equal, but the collator compares them as they stand
    ordered = F.coalesce(composed(F.when(F.col("form").rlike(r"\p{M}{2}"), F.col("form"))), "form")
    return cut_lineage(distinct.select("raw", "text", _id(composed(F.col("form"))).alias("exact"), ordered.alias("form")))


def variants(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(raw, class_id, text): the distinct texts that look like another distinct text, with their class. known: digests(documents).

    Texts are grouped by their mapped form under accent-sensitive Unicode collation in SQL, and each is joined
    with its group. A group whose texts are all one in their exact composed form is a class; one in which the
    collation took texts for equal that look different (digits of other scripts, punctuation that it compares
    alike) is split by the exact form. Blank texts have no class.
    """
    view = "turnloom_lookalikes"
    members_of(documents, known).createOrReplaceTempView(view)
    found = documents.sparkSession.sql(
        f"""WITH looks AS (SELECT collate(form, 'UNICODE') AS look, min(exact) AS least, max(exact) AS most FROM {view} GROUP BY collate(form, 'UNICODE') HAVING count(*) > 1),
                 joined AS (SELECT m.raw, m.text, m.exact, l.least = l.most AS whole FROM {view} m JOIN looks l ON collate(m.form, 'UNICODE') = l.look),
                 split AS (SELECT exact FROM joined WHERE NOT whole GROUP BY exact HAVING count(*) > 1)
            SELECT raw, exact AS class_id, text FROM joined WHERE whole
            UNION ALL SELECT j.raw, j.exact, j.text FROM joined j LEFT SEMI JOIN split s ON j.exact = s.exact WHERE NOT j.whole"""
    )
    return found


def pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every two documents whose texts look the same but aren't equal.

    Texts are paired first and expanded to their copies afterwards, so copies of one text never meet. Documents
    without a doc_id take no part. Large classes and often copied texts meet block by block.
    """
    all_ = digests(documents)
    known = cut_lineage(variants(documents, all_).select("raw", "class_id"))
    sizes = known.groupBy("class_id").agg(F.count(F.lit(1)).alias("members"))
    two = within(known.join(sizes.hint("merge"), "class_id").select(F.col("class_id").alias("rep"), F.col("raw").alias("id"), "members")).toDF("a", "b")
    copies = having(all_.select("doc_id", "raw"), known, "raw")
    heads = cut_lineage(copies.groupBy(F.col("raw").alias("rep")).agg(F.count(F.lit(1)).alias("members")))
    sized = two.join(blocks_of(heads, "a", "blocks_a"), "a").join(blocks_of(heads, "b", "blocks_b"), "b")
    members = copies.join(heads, F.col("raw") == F.col("rep")).select("rep", F.col("doc_id").alias("id"), "members")
    return between(sized, members).where("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def canonical(documents: DataFrame) -> DataFrame:
    """(doc_id, text, class_id) of every document, text in the form of its class.

    The canonical member of a class is its shortest text in bytes, of those the least by code points;
    texts that look like no other stay as they are, with a NULL class_id. NULL and blank texts stay too.
    """
    known = cut_lineage(variants(documents, digests(documents)))
    chosen = known.groupBy("class_id").agg(F.min(F.struct(F.octet_length("text").alias("size"), F.col("text"))).alias("best")).select("class_id", F.col("best.text").alias("canonical"))
    of = known.select("raw", "class_id").join(chosen, "class_id")
    rows = documents.select("doc_id", "text", F.when(F.col("text").isNotNull(), _id(F.col("text"))).alias("raw"))
    return looked_up(rows, of, "raw").select("doc_id", F.coalesce("canonical", "text").alias("text"), "class_id")
