"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines (split at line feeds, those with a word) are trimmed, lowered and hashed. A line that more documents of one host
hold than the limit (a share of the host's documents, and a floor) is boilerplate there: cleaned() removes it, and
judged() counts its words. A document that keeps too few of its words is depleted and rejected, as is one that fails the
base rules (under 10 words, or over a fifth of its words in repeated 5-word windows).

Documents are counted by doc_id, so repeated rows of one id count once; rows without an id count by text. Null texts have
no word and fail. A null host is a host of its own, and so is an empty one. Repeated rows are judged alike. Empty tables
give no rows; columns besides doc_id, text and the host column are ignored (cleaned() keeps them). Word windows, lines and
document ids are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

BLANK = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]++"
#: Documents of one host that may hold a line: so many, or this share of the host's documents if that is more.
FLOOR = 5
SHARE = 0.02
#: A document must keep so many words, and this share of its words.
LEAST_WORDS = 5
LEAST_SHARE = 0.3
WINDOW = 5


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANK))
    return F.when(F.length(inner) > 0, F.split(inner, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    one = docs.withColumns({"__sw_w": words(text), "__sw_l": with_word})
    # hashes of all words, then of all windows; a hash that occurs twice sends the text through the sort below
    two = one.withColumn("__sw_h", F.transform("__sw_w", lambda w: F.xxhash64(w)))
    n = F.size("__sw_w")
    grams = F.when(n >= WINDOW, F.transform(F.slice("__sw_h", 1, n - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get("__sw_h", i + k) for k in range(1, WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    three = two.withColumn("__sw_g", grams)
    order = F.array_sort(F.transform("__sw_g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    four = three.withColumn("__sw_s", F.when(F.size(F.array_distinct("__sw_g")) < F.size("__sw_g"), order))
    s = F.col("__sw_s")
    twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["g"] == x["g"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["g"] == x["g"])))
    five = four.withColumn("__sw_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # windows that start at p cover p to p + 4: each adds what lies beyond the one before
    state = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("__sw_p", state, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    six = five.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__sw_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long"),
        "n_dup_lines": (F.size("__sw_l") - F.size(F.array_distinct("__sw_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return six.withColumn("base_failed", failed).drop(*(f"__sw_{x}" for x in "wlhgsp"))


def keyed(docs: DataFrame, host: str) -> DataFrame:
    """docs with __sw_host (never null: a null host differs from an empty one), __sw_doc (hash of the id) and __sw_text (hash of the text)."""
    doc = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(1))).otherwise(F.xxhash64("doc_id"))
    return docs.withColumns({"__sw_host": F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")), "__sw_doc": doc, "__sw_text": F.xxhash64("text")})


def lines(docs: DataFrame) -> DataFrame:
    """docs as keyed() gives them. One row for each line with a word: its document, host, text, number, hash and count of words."""
    parted = docs.select("__sw_host", "__sw_doc", "__sw_text", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    trimmed = parted.withColumn("line", F.lower(F.btrim("line", F.lit(BLANK)))).where("length(line) > 0")
    return trimmed.select("__sw_host", "__sw_doc", "__sw_text", "at", F.xxhash64("line").alias("line_hash"), F.size(F.split("line", BLANK_RUN)).alias("n"))


def boilerplate(docs: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """__sw_host and line_hash of the lines that more documents of the host hold than the limit."""
    seen = lines(docs).select("__sw_host", "line_hash", "__sw_doc").distinct()
    often = seen.groupBy("__sw_host", "line_hash").agg(F.count("*").alias("held")).where(F.col("held") > floor)
    size = docs.select("__sw_host", "__sw_doc").distinct().groupBy("__sw_host").agg(F.count("*").alias("documents"))
    return often.join(size, "__sw_host").where(F.col("held") > share * F.col("documents")).select("__sw_host", "line_hash")


def removed(docs: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """__sw_doc, __sw_host, __sw_text, at (the numbers of its boilerplate lines) and words (in them); texts without such a line are absent."""
    found = lines(docs).join(boilerplate(docs, floor, share), ["__sw_host", "line_hash"])
    # rows that share id, host and text have the same lines: take those of one
    once = found.dropDuplicates(["__sw_doc", "__sw_host", "__sw_text", "at"])
    return once.groupBy("__sw_doc", "__sw_host", "__sw_text").agg(F.collect_list("at").alias("__sw_at"), F.sum("n").alias("__sw_words"))  # no more than the text's lines


def marked(docs: DataFrame, host: str, floor: int, share: float) -> DataFrame:
    """docs with __sw_at and __sw_words (null where no line is boilerplate)."""
    rows = keyed(docs, host)
    return rows.join(removed(rows, floor, share), ["__sw_doc", "__sw_host", "__sw_text"], "left")


def cleaned(docs: DataFrame, host: str = "source", floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """docs, their texts without boilerplate lines."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__sw_at", i))
    text = F.when(F.col("__sw_at").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return marked(docs, host, floor, share).withColumn("text", text).select(docs.columns)


def judged(docs: DataFrame, host: str = "source", floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept."""
    rows = keyed(docs.select("doc_id", "text", host), host)
    counted = base_counts(rows).drop("text")
    both = counted.join(removed(rows, floor, share).drop("__sw_at"), ["__sw_doc", "__sw_host", "__sw_text"], "left")
    both = both.withColumn("removed_words", F.coalesce("__sw_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.least("removed_words", "n_words")
    depleted = (F.col("removed_words") > 0) & ((left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words"]
    return both.select(*names, (~F.col("base_failed") & ~depleted).alias("kept"))


def op9_line_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))


BASE_SQL = r"""
with t as (select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select *, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) else [] end as g from w),
p as (select doc_id, unnest(g) as gram, generate_subscripts(g, 1) as i from g),
d as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from p),
c as (select doc_id, count(distinct i + k) as r from d, (select unnest(range(0, 5)) as k) where n > 1 group by 1),
line as (select doc_id, host, text, lower(trim(unnest(l), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as line from w),
size as (select host, count(distinct doc_id) as documents from t group by 1),
often as (select host, line from line join size using (host) group by host, line, documents having count(distinct doc_id) > greatest(5, 0.02 * documents)),
gone as (select doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as gone from line join often using (host, line) group by 1),
b as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r, 0)::bigint as n_repeat_words, coalesce(gone, 0)::bigint as removed_words from w left join c using (doc_id) left join gone using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  not base_failed and not (removed_words > 0 and (n_words - removed_words < 5 or n_words - removed_words < 0.3 * n_words)) as kept from f
"""
