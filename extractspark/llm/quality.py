"""Quality rules: divergence of a document from its language's reference. DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with those of its language by
the Jensen-Shannon distance (base 2: 0 equal, 1 disjoint). Short documents say little, so there are least lengths: from
``MIN_CHARS`` characters on the two distances together must not pass ``MAX_BOTH``. Before that, two plain rules: at least
50 words, and at most half of the words in repeated three-word windows. Judging is one projection over whole texts; rows
never meet, so nothing is shuffled.

``fit`` takes the references from documents labelled as good (of all documents, if none is): shares of the six classes, and
the 20 most frequent words with their shares, for each language that has ``LEAST`` documents in the sample. The sample has
at most ``sample`` documents, the first by a hash of doc_id; that is the one bound. What is collected grows with the number
of languages, of which there are no more than codes of two or three letters.

A language is the part of the tag before - or _, whatever its case. A document of no known language (null, another kind of
tag, or one without a reference) is judged by its character classes only, against all sampled documents together, from
``MIN_CLASS_CHARS`` characters on. Without any reference only the plain rules judge.

Words are runs without ASCII white space. Windows are told apart by 64-bit hashes. They are sorted with their positions
as single longs; where two windows of a document differ only in the bits that hold the position, or there are more words
than those bits count, pairs are sorted instead.

Defined results: a null text is an empty one; a document without words has no counts and fails the plain rules; equal
frequencies of words are ranked by the word; repeated rows are judged each for itself; a text of any length is judged
whole, in one task; a null doc_id stays null; an empty table gives no rows. ``score`` returns its own columns only;
``filter_kept`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Least words; highest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Highest sum of both distances and the least characters for it; the same for the distance of classes alone.
MAX_BOTH, MIN_CHARS, MAX_CLASS, MIN_CLASS_CHARS = 0.46, 250, 0.18, 800
#: Documents to fit the references, least documents of a language in them, and its common words.
SAMPLE, LEAST, COMMON = 3000, 20, 20
SPACE = r"[\x20\x09-\x0D]+"
TAG = "^([a-z]{2,3})([-_].*)?$"
#: Low bits of a sorted window that hold its position.
PLACE_BITS = 26


@dataclass(frozen=True)
class Reference:
    """Shares of the character classes, and common words with their shares of all words."""

    classes: tuple[float, ...]
    words: tuple[str, ...] = ()
    shares: tuple[float, ...] = ()


#: By language; "" is the reference of all sampled documents together, of classes only.
References = dict[str, Reference]


def language(docs: DataFrame) -> Column:
    tag = F.lower(F.col("lang").cast("string")) if "lang" in docs.columns else F.lit("")
    return F.regexp_extract(F.coalesce(tag, F.lit("")), TAG, 1)


def plain_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit(".,")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def odd_part(text: Column) -> Column:
    """What is neither a lower-case letter nor ASCII white space."""
    return F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "")


def without(pattern: str) -> Column:
    """How many characters of the column odd the pattern takes."""
    return F.length("odd") - F.length(F.regexp_replace("odd", pattern, ""))


#: Counts from the column odd, by name.
ODD = {"n_odd": lambda: F.length("odd"), "n_upper": lambda: without(r"\p{Lu}+"), "n_digits": lambda: without("[0-9]+"), "n_points": lambda: without(r"""[.,;:!?'"()\-]+""")}


def class_counts() -> Column:
    """Lower-case and upper-case letters, digits, white space, punctuation and the rest, from the columns that ODD names."""
    space = F.col("chars") - F.col("word_chars")
    rest = F.col("n_odd") - F.col("n_upper") - F.col("n_digits") - F.col("n_points")
    return F.array(F.col("chars") - F.col("n_odd") - space, F.col("n_upper"), F.col("n_digits"), space, F.col("n_points"), rest).cast("array<bigint>")


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, least: int = LEAST) -> References:
    """References from at most ``sample`` documents labelled as good; of all documents if there is none."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, sample, least)


def _fit(docs: DataFrame, labels: DataFrame | None, sample: int, least: int) -> References:
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(docs).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    first = lambda ids: ids.distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    picked = first(known.select("doc_id"))
    if labels is not None:
        good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1 and doc_id is not null").select("doc_id")
        if not good.isEmpty():
            picked = first(good)
    # At most sample ids.
    rows = written(known.join(F.broadcast(picked), "doc_id"), "quality-sample")
    split = rows.select("lang", F.length("text").alias("chars"), words_of(F.col("text")).alias("words"), odd_part(F.col("text")).alias("odd"))
    counted = split.select("lang", "chars", F.length(F.array_join("words", "")).alias("word_chars"), *[made().alias(name) for name, made in ODD.items()])
    parts = counted.select("lang", class_counts().alias("c")).groupBy("lang").agg(F.count("*").alias("docs"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(6)]).collect()
    # The frequent words of each language, and how many words it has.
    frequent = split.where("lang <> ''").select("lang", F.explode(plain_words(F.col("words"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.when(F.col("word") != "", F.struct((-F.col("n")).alias("n"), "word"))))
    tops = {r["lang"]: r for r in frequent.groupBy("lang").agg(F.sum("n").alias("total"), F.slice(ranked, 1, COMMON).alias("top")).collect()}
    out: References = {}
    sums = {r["lang"]: (r["docs"], [r[f"c{i}"] for i in range(6)]) for r in parts}
    sums[""] = (sum(n for n, _ in sums.values()), [sum(c[i] for _, c in sums.values()) for i in range(6)])
    for lang, (n, counts) in sums.items():
        if n < least or not sum(counts):
            continue
        top = tops[lang]["top"] if lang in tops else []
        if lang and not top:
            continue
        out[lang] = Reference(tuple(c / sum(counts) for c in counts), tuple(t["word"] for t in top), tuple(-t["n"] / tops[lang]["total"] for t in top))
    return out


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram (an array of counts) from an array of shares; 0 for an empty one."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def terms(x: Column) -> Column:  # of one class: n counted, t in all, q its share
        p, q = x["n"] / x["t"], x["q"]
        m = (p + q) / 2
        return F.when(x["n"] > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    paired = F.zip_with(counts, shares, lambda n, q: F.struct(n.alias("n"), total.alias("t"), q.alias("q")))
    both = F.aggregate(paired, F.lit(0.0), lambda a, x: a + terms(x))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), both / 2))).otherwise(0.0)


def lookup(references: References, made: dict[str, Column], kind: str) -> Column:
    """A value by the column lang: a map of constants."""
    pairs = [x for lang in references for x in (F.lit(lang), made[lang].cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None).cast(kind)


def measured(docs: DataFrame, references: References, *kept: Column) -> DataFrame:
    """All counts and distances; kept are columns to carry along."""
    carried = [c.alias(f"kept_{i}") for i, c in enumerate(kept)]
    names = [f"kept_{i}" for i in range(len(kept))]
    tag = language(docs)
    lang = F.when(tag.isin(*[x for x in references if x]), tag).otherwise("") if any(references) else F.lit("")
    start = docs.select(*carried, lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = sorted({w for r in references.values() for w in r.words})
    # Each step is a projection of its own: what a lambda uses many times must be a column by then.
    split = start.select(
        *names, "lang", F.length("text").alias("chars"), words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        odd_part(F.col("text")).alias("odd"),
    )
    n = F.size("words")
    hashed = split.select(
        *names, "lang", "chars", "odd", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.filter(plain_words(F.col("words")), lambda w: w.isin(*frequent)) if frequent else F.array().cast("array<string>")).alias("common"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    nothing = F.array().cast("array<bigint>")
    windows = hashed.withColumn("windows", F.when(F.size("hashes") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size("hashes") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)))).otherwise(nothing)).drop("hashes")
    mask = (1 << PLACE_BITS) - 1
    high = lambda h: h.bitwiseAND(F.lit(~mask))
    different = windows.withColumn("different", F.size(F.array_distinct("windows")))
    # Positions in an order that brings equal windows together.
    told_apart = (F.size(F.array_distinct(F.transform("windows", high))) == F.col("different")) & (F.size("windows") <= mask)
    by_long = F.transform(F.sort_array(F.transform("windows", lambda h, i: high(h).bitwiseOR(i.cast("long")))), lambda x: x.bitwiseAND(F.lit(mask)))
    by_pair = F.transform(F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), lambda x: x["i"])
    placed = different.withColumn("placed", F.when(F.col("different") == F.size("windows"), nothing).when(told_apart, by_long).otherwise(by_pair)).drop("different")
    at = lambda k: F.get("windows", F.get("placed", k).cast("int"))
    same = lambda a, b: F.coalesce(at(a) == at(b), F.lit(False))
    found = placed.withColumn("found", F.sort_array(F.array_compact(F.transform("placed", lambda x, k: F.when(F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False)) | same(k, k + 1), x))))).drop("windows", "placed")
    steps = F.transform("found", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("found", k + 1) - x, F.lit(3))))
    repeated = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)
    counted = found.select(
        *names, "lang", "chars", "n_words", "word_chars", "n_dup_lines", "common", repeated.alias("n_repeat_words"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"), *[made().alias(name) for name, made in ODD.items()],
        lookup(references, {k: F.array(*map(F.lit, r.classes)) for k, r in references.items()}, "array<double>").alias("ref_classes"),
        lookup(references, {k: F.array(*map(F.lit, r.words)) if r.words else F.array() for k, r in references.items()}, "array<string>").alias("ref_words"),
        lookup(references, {k: F.array(*map(F.lit, (*r.shares, 1.0 - sum(r.shares)))) for k, r in references.items()}, "array<double>").alias("ref_shares"),
    )
    each = F.transform("ref_words", lambda w: F.size(F.filter("common", lambda x: x == w)).cast("bigint"))
    tallied = counted.withColumn("classes", class_counts()).withColumn("each", each)
    tallied = tallied.withColumn("tally", F.concat("each", F.array(F.col("n_words") - F.aggregate("each", F.lit(0).cast("bigint"), lambda a, n: a + n))))
    judged = tallied.withColumn("class_distance", F.coalesce(distance(F.col("classes"), F.col("ref_classes")), F.lit(0.0)))
    judged = judged.withColumn("common_distance", F.when(F.col("lang") != "", distance(F.col("tally"), F.col("ref_shares"))).otherwise(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    alone = (F.col("chars") < MIN_CLASS_CHARS) | (F.col("class_distance") <= MAX_CLASS)
    usual = F.when(F.col("lang") == "", alone).otherwise((F.col("chars") < MIN_CHARS) | (F.col("class_distance") + F.col("common_distance") <= MAX_BOTH))
    verdict = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & usual)
    # A filter on a plain column would be pushed below the projections, each of which would then be computed anew for
    # every use. It can't be pushed below what an array of one row is taken apart by.
    whole = F.struct(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept")
    return verdict.select(F.explode(F.array(whole)).alias("row")).select("row.*")


def score(docs: DataFrame, references: References) -> DataFrame:
    """doc_id, counts, distances and the verdict."""
    return measured(docs, references, F.col("doc_id").cast("long")).select(
        F.col("kept_0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"),
    )


def filter_kept(docs: DataFrame, references: References) -> DataFrame:
    """The rows that the rules keep, with the input's own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return measured(docs, references, whole).where("kept").select("kept_0.*")


def score_sql() -> str:
    """DuckDB SQL for the rows of score(documents, fit(documents, labels))."""
    without = lambda p: f"length(odd) - length(regexp_replace(odd, '{p}', '', 'g'))"

    def distance_sql(counts: str, shares: str) -> str:
        each = f"list_transform(list_zip({counts}, {shares}), lambda x: case when x[1] > 0 then x[1] / list_sum({counts}) * log2(x[1] / list_sum({counts}) / ((x[1] / list_sum({counts}) + x[2]) / 2)) else 0.0 end + case when x[2] > 0 then x[2] * log2(x[2] / ((x[1] / list_sum({counts}) + x[2]) / 2)) else 0.0 end)"
        return f"case when list_sum({counts}) > 0 then sqrt(greatest(0.0, list_sum({each}) / 2)) else 0.0 end"

    return rf"""
with start as (select row_number() over () as row_no, doc_id::bigint as doc_id, regexp_extract(coalesce(lower(lang), ''), '{TAG}', 1) as tag, coalesce(text, '') as text from documents),
split as (select *, length(text) as chars,
    list_filter(string_split_regex(text, '[ 	-
]+'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) as lines,
    regexp_replace(text, '[\p{{Ll}} 	-
]+', '', 'g') as odd from start),
repeats as (select row_no, count(distinct p) as n_repeat_words from (
    select row_no, unnest([i, i + 1, i + 2]) as p from (
        select row_no, i, count(*) over (partition by row_no, a, b, c) as n from (
            select row_no, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
            from (select row_no, words, unnest(range(1, len(words) - 1)) as i from split)))
    where n >= 2) group by row_no),
counted as (select split.*, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    {without('[#*$%&|<>]+')} as n_symbols, length(odd) as n_odd, {without(chr(92) + 'p{Lu}+')} as n_upper, {without('[0-9]+')} as n_digits,
    {without('[.,;:!?' + chr(39) * 2 + chr(34) + '()' + chr(92) + '-]+')} as n_points,
    list_transform(words, lambda w: rtrim(lower(w), '.,')) as plain from split left join repeats using (row_no)),
classed as (select *, [chars - n_odd - (chars - word_chars), n_upper, n_digits, chars - word_chars, n_points, n_odd - n_upper - n_digits - n_points]::double[] as classes from counted),
good as (select distinct doc_id::bigint as doc_id from labels where quality = 1 and doc_id is not null),
pool as (select doc_id from good union select distinct doc_id from start where doc_id is not null and not exists (select 1 from good)),
picked as (select doc_id from pool order by md5(doc_id::varchar), doc_id limit {SAMPLE}),
sampled as (select classed.* from classed join picked using (doc_id)),
sums as (select tag, count(*) as docs, sum(classes[1]) as a, sum(classes[2]) as b, sum(classes[3]) as c, sum(classes[4]) as d, sum(classes[5]) as e, sum(classes[6]) as f from sampled group by tag),
every as (select * from sums where tag <> '' union all select '', sum(docs), sum(a), sum(b), sum(c), sum(d), sum(e), sum(f) from sums),
shares as (select tag, list_transform([a, b, c, d, e, f], lambda x: x / (a + b + c + d + e + f)) as ref_classes from every where docs >= {LEAST} and a + b + c + d + e + f > 0),
frequent as (select tag, w, count(*) as n from (select tag, unnest(plain) as w from sampled where tag <> '') group by tag, w),
ranked as (select *, row_number() over (partition by tag, w = '' order by n desc, w) as nth, sum(n) over (partition by tag) as total from frequent),
top as (select tag, list(w order by nth) as ref_words, list(n / total order by nth) as each_share from ranked where w <> '' and nth <= {COMMON} group by tag),
refs as (select shares.tag as lang, ref_classes, coalesce(ref_words, []) as ref_words, list_append(coalesce(each_share, []), 1.0 - coalesce(list_sum(each_share), 0.0)) as ref_shares from shares left join top using (tag) where tag = '' or ref_words is not null),
placed as (select classed.*, case when tag in (select lang from refs) then tag else '' end as lang from classed),
tallied as (select placed.*, ref_classes, ref_shares, list_transform(ref_words, lambda w: len(list_filter(plain, lambda x: x = w)))::double[] as each from placed left join refs using (lang)),
measured as (select *, list_append(each, n_words - coalesce(list_sum(each), 0.0)) as tally from tallied),
judged as (select *, coalesce({distance_sql('classes', 'ref_classes')}, 0.0) as class_distance, case when lang <> '' then {distance_sql('tally', 'ref_shares')} else 0.0 end as common_distance,
    (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words) as base_failed from measured)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    n_repeat_words::bigint as n_repeat_words, base_failed,
    (not base_failed and case when lang = '' then chars < {MIN_CLASS_CHARS} or class_distance <= {MAX_CLASS} else chars < {MIN_CHARS} or class_distance + common_distance <= {MAX_BOTH} end) as kept,
    round(class_distance, 6) as class_distance, round(common_distance, 6) as common_distance
from judged"""
