"""Texts that lost their end: structure left open, marks of a cut, and missing terminators against a baseline.

A stack automaton reads every value once and reports what is still open at its end, a mark that a cut left behind,
broken bytes or escapes, whether the last sentence is finished (a sign-off, tag or link may follow it), and whether any
sentence of it ends in a full stop. A missing terminator counts where the source writes sentences at all. Its baseline
counts full stops anywhere in a value, inner ones too, which a cut at the end leaves standing: so it does not sink
where a source cuts most of its values. Values of sources without sentences, such as titles, are judged by the limits
of their source and by how often their last word ends a title elsewhere.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..plans.lineage import cut
from ..plans.shipping import ship
from ..plans.skew import join_small

#: Opening signs and what closes them.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“", "「": "」"}
CLOSERS = set(PAIRS.values())
#: Short forms whose full stop ends no sentence.
SHORT_FORMS = {"incl.", "approx.", "rs.", "st.", "no.", "mr.", "mrs.", "ms.", "dr.", "prof.", "e.g.", "i.e.", "vs.", "ca.", "tel.", "etc.,"}
#: A source writes sentences if at least this share of its values holds a full stop (titles hold next to none, texts hold some in nearly all). PRIOR values at the mean share of the field's sources are added to each source's.
BASELINE, PRIOR = 0.2, 1.0
#: A limit of a source is its greatest length where so many values heap up, STEEP times the mean of the HEAP lengths below, and more than half of them do not end as values do.
AT_LIMIT, HEAP, STEEP = 3, 10, 4
#: A last word that ends a title in fewer than RARE of its uses (longer words that begin with it included) marks a cut; below DOUBT it is a suspicion that a whole text may confirm.
RARE, DOUBT = 0.04, 0.5
#: A word that never stands inside a title is a torn one if longer words begin with it, unless it ends more titles than EXPECTED per use of those.
EXPECTED = 0.02

_STRUCTURE = re.compile(r"[()\[\]{}“”«»„「」]|</?[A-Za-z][^<>]*$|<[^<>]*$")
_MARK = re.compile(r"(?:\[(?:\.\.\.|…)\]|(?:\.\.\.|…)\s*\[\+?\d+ chars?\]|\.\.\.|…|\(more\)|read more|\[more\])\s*$", re.I)
_BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|&#?\w{0,8}|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-Fa-f]?)$")
_SENTENCE_END = re.compile(r"[.!?。।؟](?:[”\"’'»)\]]|\s»)*(?=\s|$)")
_SIGN_OFF = re.compile(
    r"""^(?:
        [—–-]+\s*\S+(?:\s\S+){0,4}              # — the owners
      | \([^()]+\) | \[(?!\.\.\.|…|\+)[^\[\]]+\]   # (desk)  [video]
      | (?:\#[\w-]+\s*)+                        # tags
      | [^\w\s“«(\[{]+(?:\s[^\w\s“«(\[{]+)*     # signs and emoji
      | (?:\S+\s){0,4}(?:https?://|www\.)\S+    # a link, with a few words before it
      | [A-Z][\w-]*(?:\s\w+)?:\s\S.*            # Photo: staff
      | .*\b\d{1,2}:\d{2}                       # Check-in 14:00 / check-out 11:00
    )$""",
    re.X | re.S,
)


def read_structure(text: str) -> tuple[str | None, bool, bool]:
    """Evidence of a cut in the text itself (``open``, ``mark``, ``broken`` or None), whether it is finished, and whether a full stop ends any of its sentences."""
    t = text.rstrip()
    if not t:
        return None, True, False
    mark = _MARK.search(t)
    # ends of sentences, without short forms and amounts
    ends = []
    for m in _SENTENCE_END.finditer(t, 0, mark.start() if mark else len(t)):
        word = t[max(0, m.end() - 40) : m.end()].rsplit(None, 1)[-1].lower().strip("“\"'(")
        before = t[max(0, m.end() - 80) : m.end()].split()[-2:-1]
        if not (word in SHORT_FORMS or (re.fullmatch(r"\d[\d,]*\.", word) and before and before[0].lower().rstrip(".") in ("rs", "no", "approx"))):
            ends.append(m)
    stops = any(m.group()[0] in ".।。" for m in ends)
    if mark:
        return "mark", False, stops
    if _BROKEN.search(t):
        return "broken", False, stops
    stack: list[tuple[str, int]] = []
    for m in _STRUCTURE.finditer(t):
        sign = m.group()
        if stack and sign == PAIRS.get(stack[-1][0]):
            stack.pop()
        elif sign in PAIRS:
            stack.append((sign, m.start()))
        elif sign[0] == "<" and len(sign) > 1 and not sign[1:2].isspace() and not sign[1:2].isdigit():
            return "open", False, stops  # markup torn inside a tag
    # a sign that opens after the last finished sentence; one left open before that is a slip of the writer
    if stack and stack[-1][1] >= (ends[-2].end() if len(ends) > 1 and ends[-1].end() == len(t) else ends[-1].end() if ends and ends[-1].end() < len(t) else 0):
        return "open", False, stops
    if not ends:
        return None, False, stops
    tail = t[ends[-1].end() :].strip()
    return None, not tail or bool(_SIGN_OFF.match(tail)), stops


STRUCTURE = StructType([StructField("evidence", StringType()), StructField("finished", BooleanType()), StructField("stops", BooleanType())])


def structure(text: Column) -> Column:
    """Column of struct ``evidence, finished, stops``; null texts give a null evidence and count as finished."""

    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_structure(x) if isinstance(x, str) else (None, True, False) for x in texts], columns=["evidence", "finished", "stops"])

    return F.pandas_udf(read, STRUCTURE)(text)


def _last_words(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """``word, rate, torn``: of every last word, the share of its uses that end a text, and whether it looks torn."""
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    texts = values.select("field_name", "value").unionByName(corpus.select("field_name", "value")).where(F.col("value").isNotNull()).distinct()
    each = texts.select("field_name", F.posexplode(words(F.col("value"))).alias("at", "word"), F.size(words(F.col("value"))).alias("n"))
    counts = each.groupBy("field_name", "word").agg(F.sum(F.when(F.col("at") == F.col("n") - 1, 1).otherwise(0)).alias("ends"), F.sum(F.when(F.col("at") < F.col("n") - 1, 1).otherwise(0)).alias("inside"))
    counts = cut(counts)  # one row per word of a field
    last = counts.where(F.col("ends") > 0)
    prefixes = counts.where(F.length("word").between(2, 60)).select("field_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"), (F.col("ends") + F.col("inside")).alias("uses"))
    longer = prefixes.groupBy("field_name", "word").agg(F.sum("uses").alias("longer"))
    joined = last.join(longer, ["field_name", "word"], "left").withColumn("longer", F.coalesce("longer", F.lit(0)))
    torn = (F.col("inside") == 0) & (F.col("longer") > 0) & (F.col("ends") <= F.greatest(F.lit(2.0), F.col("longer") * EXPECTED))
    return joined.select("field_name", "word", (F.col("ends") / (F.col("ends") + F.col("inside") + F.col("longer"))).alias("rate"), torn.alias("torn"))


def _limits(rows: DataFrame) -> DataFrame:
    """``field_name, key, most``: the greatest length of each source that a cut at a limit explains, whatever share of the values it meets."""
    sizes = rows.groupBy("field_name", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("finished") & ~F.coalesce(F.col("rate") >= DOUBT, F.lit(False)), 1)).alias("odd"))  # one row per length
    longest = sizes.groupBy("field_name", "key").agg(F.max("size").alias("most"))
    heaps = join_small(sizes, longest, ["field_name", "key"]).groupBy("field_name", "key", "most").agg(
        F.sum(F.when(F.col("size") == F.col("most"), F.col("n")).otherwise(0)).alias("at"), F.sum(F.when(F.col("size") == F.col("most"), F.col("odd")).otherwise(0)).alias("odd"),
        F.sum(F.when(F.col("size").between(F.col("most") - HEAP, F.col("most") - 1), F.col("n")).otherwise(0)).alias("below"),
    )
    return heaps.where((F.col("at") >= F.greatest(F.lit(AT_LIMIT), F.col("below") * STEEP / HEAP)) & (F.col("odd") * 2 > F.col("at"))).select("field_name", "key", "most")


def cut_texts(values: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``field_name, id, source, value, evidence, doubt``: one row per distinct value of an id that seems cut.

    ``values`` has ``field_name, id, source, value``; ``corpus`` (``field_name, value``) may add whole texts of a field
    from elsewhere to the word statistics. Evidence is ``mark``, ``broken``, ``open``, ``limit`` (as long as the
    longest value of a source that heaps up there), ``terminator`` or ``word``; ``doubt`` is true where only a mild
    suspicion speaks for a cut. Null and blank values are not cut; null ids and null sources (a source of their own)
    are allowed; repeated rows count once.

    Scale: values are read once by a vectorised UDF and kept; baselines and limits are one row per field and source
    (and length); word counts are pre-aggregated and only last words are joined back.
    """
    ship(values.sparkSession)
    if corpus is None:
        corpus = values.select("field_name", "value").limit(0)
    rows = values.select("field_name", "id", "source", "value").where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    rows = cut(rows.withColumn("s", structure(F.col("value"))).select("field_name", "id", "source", "value", "s.evidence", "s.finished", "s.stops", F.length("value").alias("size"), F.coalesce("source", F.lit("")).alias("key")))
    by_source = rows.groupBy("field_name", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stops").cast("int")).alias("stops"))
    by_field = by_source.groupBy("field_name").agg(F.avg(F.col("stops") / F.col("n")).alias("mean"))  # sources weigh alike
    base = by_source.join(F.broadcast(by_field), "field_name").select("field_name", "key", ((F.col("stops") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR) >= BASELINE).alias("sentences"))  # one row per field
    rows = join_small(rows, cut(base), ["field_name", "key"])
    known = cut(_last_words(rows.where(~F.col("sentences")), corpus))
    rows = rows.withColumn("word", F.when(~F.col("sentences"), F.regexp_extract(F.lower(F.trim("value")), r"(\S+)$", 1)))
    rows = join_small(rows, known, ["field_name", "word"], "left")
    rows = join_small(rows, cut(_limits(rows)), ["field_name", "key"], "left")
    # a terminator of its own, or a mark that the field's whole texts carry too, ends a title
    ended, sentences = F.col("finished") & F.col("evidence").isNull(), F.col("sentences")
    evidence = (
        F.when(F.col("evidence").isin("broken", "open"), F.col("evidence"))
        .when(sentences & (F.col("evidence") == "mark"), F.lit("mark"))
        .when(~ended & (F.col("size") == F.col("most")), F.lit("limit"))
        .when(sentences & ~F.col("finished"), F.lit("terminator"))
        .when(~sentences & ~ended & (F.col("torn") | (F.col("rate") < RARE)), F.lit("word"))
    )
    doubt = evidence.isNull() & ~sentences & ~ended & (F.col("rate") < DOUBT)
    return rows.withColumn("why", evidence).withColumn("doubt", doubt).where(F.col("why").isNotNull() | F.col("doubt")).select("field_name", "id", "source", "value", F.coalesce("why", F.lit("word")).alias("evidence"), "doubt")


def confirmed(found: DataFrame, whole: DataFrame) -> DataFrame:
    """Exact check of ``found`` against whole texts (``field_name, id, whole``) where an id has any.

    A value that equals a whole text is not cut; one that begins a longer whole text is. Rows without whole texts
    stay unless they are in doubt.
    """
    texts = whole.where(F.col("whole").isNotNull()).groupBy("field_name", "id").agg(F.collect_set("whole").alias("all"))  # versions of one record
    same = F.exists("all", lambda w: F.trim(w) == F.trim("value"))
    longer = F.exists("all", lambda w: F.startswith(F.lower(w), F.lower(F.rtrim("value"))) & (F.length(w) > F.length("value")))
    checked = found.join(texts, ["field_name", "id"], "left")
    keep = F.when(F.col("all").isNull(), ~F.col("doubt")).when(same, F.lit(False)).otherwise(longer | ~F.col("doubt"))
    return checked.where(keep).drop("all", "doubt")
