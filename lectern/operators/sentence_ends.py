"""Abbreviations and sentence starters, learned from a corpus by log likelihood.

A word form is an abbreviation of its language if full stops follow it far more often than
other words, and it is short or has stops inside. A starter is a form that stands after
sentence ends more than twice as often as elsewhere. Two scans count forms with combines
before their shuffles; what is learned is one row a language, small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import MARK
from lectern.shared import shared_folder, written

#: Forms seen less often before a full stop, or before fewer kinds of next words (of 63), are no abbreviations: copies of a text prove nothing.
LEAST, LEAST_KINDS = 5, 3
#: Least weighted log likelihood of abbreviations, least log likelihood of starters, and how much likelier than elsewhere these are.
ABBREVIATION_SCORE, STARTER_SCORE, STARTER_LIFT = 0.3, 30.0, 2.0
#: Share of a full stop after an abbreviation; undotted occurrences weigh as if of so many.
SURE, PENALTY_OF = 0.99, 20
#: More learned forms of all languages together are an error.
MOST_FORMS = 100_000
#: Marks places where a sentence may end.
PLACE = "\ue002"
#: White space between words.
GAP = r"[\x20\x09-\x0D]+"


def form(word: Column) -> Column:
    """Lower case, without what is no letter or digit in front and behind, full stops behind kept."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))


def bare(shape: Column) -> Column:
    return F.regexp_replace(shape, r"\.+$", "")


def _xlog(x: Column, p: Column) -> Column:
    """x ln p, nothing of what does not occur."""
    return F.when(x == 0, 0.0).otherwise(x * F.log(p))


def _words(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, w, ahead, back: each word with its neighbours (empty at the ends); a null word for a text of none."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP), lambda w: w != "")

    def near(ws: Column) -> Column:
        at = lambda i: F.coalesce(F.get(ws, i), F.lit(""))
        return F.transform(ws, lambda w, i: F.struct(w.alias("w"), at(i + 1).alias("ahead"), at(i - 1).alias("back")))

    # words are bound by a transform(), or each neighbour would have them split anew; explode() would too, by a filter below it
    held = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.get(F.transform(F.array(words), near), F.lit(0)).alias("ws"))
    return held.select("lang", F.explode_outer("ws").alias("x")).select("lang", "x.w", "x.ahead", "x.back")


def form_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, form, n_all, n_dot (with one full stop behind), kinds (of next words after those).

    Null languages count as one named by the empty string; null texts have no words; forms
    have a letter. Equal rows count as often as they stand.
    """
    w = _words(docs, lang_col, text_col).where("w is not null")
    # words are put together before their forms are made: patterns run once for each word as it is written
    kind = (F.ascii("ahead") * 31 + F.length("ahead")) % 63
    zero = F.lit(0).cast("long")
    kinds = F.when(F.contains("w", F.lit(".")) & (F.col("ahead") != ""), F.call_function("shiftleft", F.lit(1).cast("long"), kind)).otherwise(zero)
    seen = w.groupBy("lang", "w").agg(F.count("*").alias("n"), F.bit_or(kinds).alias("kinds")).select("lang", form(F.col("w")).alias("f"), "n", "kinds")
    seen = seen.select("lang", bare(F.col("f")).alias("form"), F.regexp_like("f", F.lit(r"[^.]\.$")).alias("dot"), "n", "kinds").where(F.regexp_like("form", F.lit(r"\p{L}")))
    return seen.groupBy("lang", "form").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(zero)).alias("n_dot"), F.bit_count(F.bit_or(F.when(F.col("dot"), F.col("kinds")).otherwise(zero))).cast("long").alias("kinds"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """The counted forms with a full stop, and whether each is an abbreviation.

    `totals` is a row a language, joined by language.
    """
    totals = counts.groupBy("lang").agg(F.sum("n_all").alias("words"), F.sum("n_dot").alias("stops"))
    c = counts.where("n_dot > 0").join(F.broadcast(totals), "lang")
    k, n = F.col("n_dot"), F.col("n_all")
    p = F.col("stops") / F.col("words")
    likelihood = -2 * (_xlog(k, p) + _xlog(n - k, 1 - p) - k * F.log(F.lit(SURE)) - (n - k) * F.log(F.lit(1 - SURE)))
    inner = F.length("form") - F.length(F.replace("form", F.lit("."), F.lit("")))
    letters = F.length("form") - inner
    weight = F.exp(-letters) * (inner + 1) * F.pow(letters, -PENALTY_OF * (n - k) / n)
    verdict = (k >= LEAST) & (F.col("kinds") >= LEAST_KINDS) & (likelihood * weight >= ABBREVIATION_SCORE)
    return c.select("lang", "form", "n_all", "n_dot", "kinds", verdict.alias("abbreviation"))


def starters(docs: DataFrame, counts: DataFrame, known: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, form, n_all, n_start of forms that start sentences: after `.`, `?` or `!` but not after an abbreviation (`known`: lang, forms).

    `known` has a row a language.
    """
    w = _words(docs, lang_col, text_col)
    w = w.where(F.endswith("back", F.lit(".")) | F.endswith("back", F.lit("?")) | F.endswith("back", F.lit("!")))
    w = w.join(F.broadcast(known.select("lang", F.col("forms").alias("__k"))), "lang", "left")
    w = w.where(~F.coalesce(F.endswith("back", F.lit(".")) & F.array_contains("__k", bare(form(F.col("back")))), F.lit(False)))
    begun = w.groupBy("lang", "w").agg(F.count("*").alias("n")).select("lang", bare(form(F.col("w"))).alias("form"), "n")
    begun = begun.where(F.regexp_like("form", F.lit(r"\p{L}"))).groupBy("lang", "form").agg(F.sum("n").alias("n_start"))
    totals = counts.groupBy("lang").agg(F.sum("n_all").alias("words")).join(begun.groupBy("lang").agg(F.sum("n_start").alias("starts")), "lang")
    c = begun.join(counts.select("lang", "form", "n_all"), ["lang", "form"]).join(F.broadcast(totals), "lang")
    n, k, N, S = (F.col(x) for x in ("n_all", "n_start", "words", "starts"))
    p, p1 = n / N, k / S
    p2 = F.when(N > S, (n - k) / F.nullif(N - S, F.lit(0))).otherwise(0.0)
    rest = lambda q: _xlog(k, q) + _xlog(S - k, 1 - q)
    elsewhere = lambda q: _xlog(n - k, q) + _xlog(N - S - (n - k), 1 - q)
    likelihood = -2 * (rest(p) + elsewhere(p) - rest(p1) - elsewhere(p2))
    return c.where((likelihood >= STARTER_SCORE) & (k * N >= STARTER_LIFT * n * S)).select("lang", "form", "n_all", "n_start")


def learned_ends(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """A row a language: lang, abbreviations, starters (sorted arrays of forms); an error beyond MOST_FORMS forms in all.

    An empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = written(form_counts(docs, lang_col, text_col), shared_folder(spark, "forms"))
    short = counts.transform(abbreviations).where("abbreviation").select("lang", "form")
    known = _listed(short, "forms")
    first = _listed(starters(docs, counts, known, lang_col, text_col).select("lang", "form"), "starters")
    none = F.array().cast("array<string>")
    out = counts.select("lang").distinct().join(known, "lang", "left").join(first, "lang", "left")
    return out.select("lang", F.coalesce("forms", none).alias("abbreviations"), F.coalesce("starters", none).alias("starters"))


def _listed(forms: DataFrame, name: str) -> DataFrame:
    """One array a language, after a count of the forms."""
    forms = written(forms, shared_folder(forms.sparkSession, name))
    n = forms.count()
    if n > MOST_FORMS:
        raise ValueError(f"{n} {name}, more than {MOST_FORMS}")
    return forms.groupBy("lang").agg(F.array_sort(F.collect_list("form")).alias(name))


def with_ends(docs: DataFrame, learned: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Documents with a column __ends for split_learned(): no shuffle, `learned` being a row a language."""
    ends = learned.select(F.col("lang").alias("__lang"), F.struct("abbreviations", "starters").alias("__ends"))
    return docs.withColumn("__lang", F.coalesce(F.col(lang_col), F.lit(""))).join(F.broadcast(ends), "__lang", "left").drop("__lang")


def split_learned(paragraph: Column, ends: Column) -> Column:
    """Sentences of a paragraph: cut after a terminator (and a closing quote) before white space, and at line feeds, but not behind an abbreviation's full stop, unless a capitalised starter follows.

    A language that nothing was learned of (null `ends`) has no abbreviations.
    """
    lines = F.regexp_replace(paragraph, r"\n+", MARK)
    cut = F.split(F.regexp_replace(lines, "(?U)([.?!][\"'’”)]?)(\\s)", "$1" + PLACE + "$2"), PLACE)

    def marked(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            last = form(F.regexp_extract(piece, r"(?U)(\S+)$", 1))
            ahead = F.regexp_extract(F.coalesce(F.get(pieces, i + 1), F.lit("")), r"(?U)^\s*(\S+)", 1)
            short = F.endswith(piece, F.lit(".")) & F.coalesce(F.array_contains(ends["abbreviations"], bare(last)), F.lit(False))
            begins = F.regexp_like(ahead, F.lit(r"^[^\p{L}\p{N}]*\p{Lu}")) & F.coalesce(F.array_contains(ends["starters"], bare(form(ahead))), F.lit(False))
            return F.when(short & ~begins, piece).otherwise(F.concat(piece, F.lit(MARK)))

        return F.array_join(F.transform(pieces, one), "")

    # the pieces are bound by a transform(), since an expression inside a lambda is computed for each element
    whole = F.element_at(F.transform(F.array(cut), marked), 1)
    found = F.transform(F.split(whole, MARK), lambda s: F.regexp_replace(s, r"(?U)^\s+", ""))
    return F.filter(found, lambda s: s != "")
