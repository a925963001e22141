"""Quality rules from the divergence of histograms, beside plain counts (operator 10; SQL functions only).

For each language, references are drawn from all its documents: the shares of character classes, and the shares of its
common words (those with at least ``common_share`` of its words, in lower case).  A document's own histograms are compared
to those of its language by the Jensen-Shannon distance (base 2, 0 to 1); the histogram of classes only from ``min_chars``
characters on and that of words only from ``min_words`` words on, for short texts diverge by chance.  A document fails
where a distance is over its limit.

The plain counts: words are runs of characters other than space and 0x09-0x0D.  For ``n_repeat_words``, hashes of all
windows of five words carry their positions and are sorted inside the row; equal neighbours are checked word by word.  Texts
in which no shorter window occurs twice are done before that.

Texts are read twice: once to count words by language, and once for all counts of a document, which are written down
(Parquet in the shared folder, removed at the program's end); class references are sums over those.

Defined cases: a null or empty text has no words and fails (fewer than ``least_words`` words); a document without a
language, or of one with less than ``least_share`` of all documents, is compared to the reference over all languages,
classes and words; equal texts of one language get equal results, repeated rows each their own, null ids too; a distance
equal to its limit passes; an empty table gives an empty result; texts of any length are read whole; the input's columns may
have any names where only rows are kept, and may not have those that ``judge`` adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import own_folder

SPACE = r"[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The reference over all languages.
ANY = "*"


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    common_share: float = 0.005
    least_share: float = 1e-3
    min_chars: int = 300
    min_words: int = 100
    max_class_distance: float = 0.3
    max_word_distance: float = 0.32

    def __post_init__(self):
        if self.common_share < 0.005:
            raise ValueError("at most 200 common words have a sign of their own: common_share is 0.005 at least")


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (a, x) -> a + x)"


def _shares(counts: str) -> str:
    return f"transform({counts}, x -> x / greatest({_sum(counts)}, 1D))"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance, base 2, of two arrays of shares of the same length."""
    part = "if(a > 0, a * log2(2 * a / (a + b)), 0D) + if(b > 0, b * log2(2 * b / (a + b)), 0D)"
    return f"sqrt(greatest(0D, {_sum(f'zip_with({p}, {q}, (a, b) -> {part})')} / 2))"


def _with_words(d: DataFrame, text: str) -> DataFrame:
    """``words`` of a text: what lies between white space, less what is empty at either end."""
    d = d.withColumn("parts", F.expr(f"split({text}, '{SPACE}+', -1)"))
    skip, spare = "if(parts[0] = '', 1, 0)", "if(parts[size(parts) - 1] = '', 1, 0)"
    return d.withColumn("words", F.expr(f"slice(parts, 1 + {skip}, greatest(0, size(parts) - {skip} - {spare}))")).drop("parts")


def _with_repeats(d: DataFrame, window: int) -> DataFrame:
    """From ``words`` and ``n_words``: ``n_repeat_words``."""

    def both(of: str, step: int) -> str:  # hash of each item with the one ``step`` places on
        return f"zip_with({of}, slice({of}, {1 + step}, greatest(0, size({of}) - {step})), (a, b) -> xxhash64(a, b))"

    none = "cast(array() AS array<bigint>)"
    shorter, width = "words", 1
    while width + min(width, window - width) < window:
        step = min(width, window - width)
        width += step
        d = d.withColumn(f"windows{width}", F.expr(f"if(n_words < {window}, {none}, {both(shorter, step)})"))
        shorter = f"windows{width}"
    last = both(shorter, window - width) if window > 1 else "transform(words, w -> xxhash64(w))"
    whole = f"slice({last}, 1, greatest(0, cast(n_words AS int) - {window - 1}))"
    # The last few of the shorter windows reach past the end, each in its own way: they are like no other.
    d = d.withColumn("windows", F.expr(f"if(n_words < {window} OR size(array_distinct({shorter})) = size({shorter}), {none}, {whole})"))
    # Where hashes repeat: sorted, with the position in as many low bits as the text needs.
    d = d.withColumn("bits", F.expr("cast(ceil(log2(greatest(n_words, 2))) AS int) + 1"))
    keys = "sort_array(transform(windows, (h, i) -> shiftleft(shiftrightunsigned(h, bits + 1), bits) + i))"
    d = d.withColumn("keys", F.expr(f"if(size(array_distinct(windows)) = size(windows), {none}, {keys})"))
    # Whether each is equal to the one before, and the positions of those next to an equal one.
    place = "cast({} & (shiftleft(1L, bits) - 1) AS int)".format
    last_key, here, there = "keys[j - 1]", place("k"), place("keys[j - 1]")
    equal = f"j > 0 AND shiftrightunsigned({last_key}, bits) = shiftrightunsigned(k, bits) AND slice(words, {there} + 1, {window}) = slice(words, {here} + 1, {window})"
    d = d.withColumn("equal", F.expr(f"transform(keys, (k, j) -> {equal})"))
    d = d.withColumn("places", F.expr(f"sort_array(transform(filter(keys, (k, j) -> equal[j] OR coalesce(get(equal, j + 1), false)), k -> {here}))"))
    # Each window covers the words up to the next one, the last all of its own.
    covered = f"aggregate(places, named_struct('n', 0L, 'upto', 0), (a, p) -> named_struct('n', a.n + p + {window} - greatest(p, a.upto), 'upto', p + {window}), a -> a.n)"
    return d.withColumn("n_repeat_words", F.expr(covered))


def _with_counts(d: DataFrame, window: int) -> DataFrame:
    """From ``text``: ``words``, the plain counts, and ``classes``, the counts of the character classes as doubles."""
    d = _with_words(d, "text").withColumn("n_words", F.size("words").cast("long")).withColumn("joined", F.array_join("words", ""))
    d = d.withColumn("word_chars", F.char_length("joined").cast("long"))
    d = d.withColumn("n_symbols", F.expr(f"regexp_count(text, '{SYMBOLS}')").cast("long"))
    d = d.withColumn("lines", F.expr(r"filter(split(text, '\\n', -1), x -> x rlike '[^ \\t-\\r]')"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = _with_repeats(d, window).withColumn("n_chars", F.char_length("text"))
    d = d.withColumn("letters", F.expr(r"char_length(regexp_replace(joined, '[^\\p{L}]+', ''))"))
    d = d.withColumn("upper", F.expr(r"regexp_count(text, '\\p{Lu}')")).withColumn("digits", F.expr(r"regexp_count(text, '\\p{Nd}')"))
    rest = "n_chars - letters - digits - (n_chars - word_chars) - n_symbols"
    return d.withColumn("classes", F.expr(f"transform(array(letters - upper, upper, digits, n_chars - word_chars, n_symbols, {rest}), x -> cast(x AS double))"))


def language_words(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """``language, common`` (words in lower case)``, signs`` (none for any other word, then one for each) ``, word_shares`` (of
    each common word and of all others) for each language with ``least_share`` of the rows, and for all together (``*``):
    at most 1 / ``least_share`` + 1 rows of at most 1 / ``common_share`` words, which is what may be broadcast.

    Words are counted exactly, by language and word, with partial sums before the shuffle.
    """
    folder = own_folder(docs.sparkSession, "quality")
    sizes = docs.groupBy(F.col(lang_col).alias("language")).count().checkpoint()
    rows = sizes.agg(F.sum("count")).first()[0] or 0
    known = sizes.filter((F.col("count") >= rules.least_share * rows) & F.col("language").isNotNull()).select("language")
    texts = docs.select(F.col(lang_col).alias("lang"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    # What is empty at an end goes after the words are rows: then the text is split once.
    words = texts.select("lang", F.explode(F.expr(f"split(text, '{SPACE}+', -1)")).alias("word")).filter("word <> ''")
    own = F.broadcast(known.withColumn("lang", F.col("language")))
    words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).join(own, "lang", "left").select("language", "word", "n").write.parquet(f"{folder}/words")
    counts = docs.sparkSession.read.schema("language string, word string, n long").parquet(f"{folder}/words")
    # Rows of no known language are a group of their own here.
    totals = counts.groupBy("language").agg(F.sum("n").alias("total")).checkpoint()
    least = F.col("n") >= rules.common_share * F.col("total")
    counts = counts.filter("language IS NOT NULL").unionByName(counts.filter("language IS NULL").groupBy("language", "word").agg(F.sum("n").alias("n")))
    common = counts.alias("c").join(F.broadcast(totals.alias("t")), F.expr("c.language <=> t.language")).select("c.language", "word", "n", "total").filter(least)
    # What is common in all together is so in one of the groups.
    candidates = F.broadcast(common.select("word").distinct())
    everything = totals.agg(F.sum("total")).first()[0] or 0
    whole = counts.join(candidates, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n")).withColumn("language", F.lit(ANY))
    whole = whole.withColumn("total", F.lit(everything).cast("long")).filter(least)
    found = (
        common.filter("language IS NOT NULL")
        .unionByName(whole)
        .groupBy("language")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("n") * -1, "word", F.col("n").cast("double").alias("n")))).alias("own"), F.first("total").alias("total"))
        .withColumn("signs", F.expr("transform(sequence(0, size(own)), i -> if(i = 0, '', char(32 + i)))"))
        .select("language", F.expr("own.word").alias("common"), "signs", F.expr(_shares(f"concat(own.n, array(total - {_sum('own.n')}))")).alias("word_shares"))
    )
    every = docs.sparkSession.createDataFrame([(ANY,)], "language string")
    return known.unionByName(every).join(found, "language", "left").checkpoint()


def _measured(docs: DataFrame, text_col: str, lang_col: str, carried: list[str], rules: Rules) -> DataFrame:
    """Written down: ``row`` (the carried columns), ``language`` (of its reference), the counts, ``classes``, ``n_chars`` and
    ``word_distance``."""
    spark = docs.sparkSession
    words = F.broadcast(language_words(docs, text_col=text_col, lang_col=lang_col, rules=rules))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    d = d.join(words.select(F.col("language").alias("lang"), F.col("language").alias("known")).filter(F.col("lang") != ANY), "lang", "left")
    d = d.select("row", "text", F.coalesce("known", F.lit(ANY)).alias("language")).join(words, "language", "left")
    d = _with_counts(d, rules.window)
    # Words that are common in some language are picked out first, by a look-up in one set of constants.
    some = sorted({w for r in words.select("common").collect() for w in r.common or ()})  # bounded, see language_words
    d = d.withColumn("picked", F.filter("words", lambda w: F.lower(w).isin(some)) if some else F.expr("cast(array() AS array<string>)"))
    # Each common word of the language leaves its sign, others none; then each sign is counted.
    worth = f"n_words >= {rules.min_words} AND size(common) > 0"
    d = d.withColumn("signed", F.expr(f"if({worth}, array_join(transform(picked, w -> signs[cast(array_position(common, lower(w)) AS int)]), ''), null)"))
    uses = "transform(slice(signs, 2, size(common)), s -> cast((octet_length(signed) - octet_length(replace(signed, s, ''))) / octet_length(s) AS double))"
    d = d.withColumn("uses", F.expr(f"if(signed IS NULL, null, {uses})"))
    d = d.withColumn("word_distance", F.expr(f"if(uses IS NULL, null, {_distance(_shares(f'concat(uses, array(n_words - {_sum("uses")}))'), 'word_shares')})"))
    folder = own_folder(spark, "quality")
    d = d.select("row", "language", *COUNTS, "classes", "n_chars", "word_distance")
    d.write.option("parquet.block.size", 32 << 20).parquet(f"{folder}/rows")  # texts may go along: less of them in memory
    return spark.read.schema(d.schema).parquet(f"{folder}/rows")


def _judged(docs: DataFrame, text_col: str, lang_col: str, carried: list[str], rules: Rules) -> DataFrame:
    """``row``, the counts, ``base_failed``, both distances and ``kept``."""
    d = _measured(docs, text_col, lang_col, carried, rules)
    sums = d.groupBy("language").agg(*[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)])
    every = sums.agg(*[F.sum(c).alias(c) for c in CLASSES]).withColumn("language", F.lit(ANY))
    shares = F.expr(_shares(f"array({', '.join(CLASSES)})")).alias("class_shares")
    d = d.join(F.broadcast(sums.filter(F.col("language") != ANY).unionByName(every).select("language", shares)), "language", "left")
    d = d.withColumn("class_distance", F.expr(f"if(n_chars >= {rules.min_chars}, {_distance(_shares('classes'), 'class_shares')}, null)"))
    d = d.withColumn("base_failed", F.expr(f"n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"))
    verdict: Column = F.expr(f"NOT base_failed AND coalesce(class_distance <= {rules.max_class_distance}, true) AND coalesce(word_distance <= {rules.max_word_distance}, true)")
    return d.select("row", *COUNTS, "base_failed", "class_distance", "word_distance", verdict.alias("kept"))


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """All columns of ``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance`` (null where the text is too short) and ``kept``."""
    new = [*COUNTS, "base_failed", "class_distance", "word_distance", "kept"]
    if clash := [c for c in docs.columns if c in new]:
        raise ValueError(f"columns {clash} are there already")
    return _judged(docs, text_col, lang_col, docs.columns, rules).select("row.*", *new)


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: its id and what ``judge`` adds."""
    d = _judged(docs.select(*{id_col: 0, text_col: 0, lang_col: 0}), text_col, lang_col, [id_col], rules)
    return d.select(F.col("row")[id_col].alias(id_col), *[c for c in d.columns if c != "row"])


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep."""
    return _judged(docs, text_col, lang_col, docs.columns, rules).filter("kept").select("row.*")
