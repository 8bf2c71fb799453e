"""Notation audit: which symbols of an inventory the alphabet has, under which form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipgrain.functions.text import lookup
from clipgrain.functions.tokens import nfc
from clipgrain.sources import reference_data as R


def strip_slashes(token: Column) -> Column:
    return F.regexp_replace(token, "^/+|/+$", "")


def to_ipa(symbol: Column) -> Column:
    """IPA of a symbol: by the whole symbol, or with the notation's rules applied from the longest on."""
    rules = sorted(R.NOTATION, key=lambda n: -len(n.symbol))
    rewritten = reduce(lambda text, n: F.replace(text, F.lit(n.symbol), F.lit(n.ipa)), rules, symbol)
    return F.coalesce(lookup({n.symbol: n.ipa for n in R.NOTATION}, symbol), F.replace(rewritten, F.lit(":"), F.lit("ː")))


def alternates(ipa: Column) -> Column:
    """Other spellings of a sound: in slashes, affricates with a tie bar, known equivalents with and without slashes."""
    none = F.array().cast("array<string>")
    slashed = lambda x: F.concat(F.lit("/"), x, F.lit("/"))
    tied = F.concat(F.substring(ipa, 1, 1), F.lit("\u0361"), F.substring(ipa, 2, 1 << 20))
    barred = F.when(ipa.isin(*R.AFFRICATES), F.array(tied, slashed(tied))).when(F.substring(ipa, 1, 2).isin(*R.AFFRICATES), F.array(tied)).otherwise(none)
    equal = F.create_map(*[x for k, others in R.EQUIVALENCES.items() for x in (F.lit(k), F.array(*map(F.lit, others)))])
    others = F.flatten(F.transform(F.coalesce(F.try_element_at(equal, ipa), none), lambda x: F.array(x, slashed(x))))
    return F.array_distinct(F.concat(F.array(slashed(ipa)), barred, others))


def alphabet(spark: SparkSession) -> DataFrame:
    """``symbol, ipa, ipa_alternates, uncertain, version`` of the fixed symbols."""
    rows = spark.createDataFrame([(n.symbol, n.uncertain) for n in R.alphabet()], "symbol string, uncertain boolean")
    rows = rows.withColumn("ipa", to_ipa(F.col("symbol")))
    return rows.select("symbol", "ipa", alternates(F.col("ipa")).alias("ipa_alternates"), "uncertain", F.lit(R.ALPHABET_VERSION).alias("version"))


def forms(spark: SparkSession, symbols: DataFrame | None = None) -> DataFrame:
    """``symbol, ipa, form``: every spelling, with slashes and without, that stands for a symbol."""
    rows = alphabet(spark) if symbols is None else symbols
    spellings = F.concat(F.array("ipa"), "ipa_alternates", F.transform("ipa_alternates", strip_slashes))
    return rows.select("symbol", "ipa", F.explode(F.array_distinct(spellings)).alias("form"))


def drift(tokens: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Adds ``ipa, matches, category`` to rows with a ``token``: direct, notation-only or phonological."""
    known = forms(tokens.sparkSession, symbols).groupBy(F.col("form").alias("ipa")).agg(F.sort_array(F.collect_set("symbol")).alias("matches"))
    table = F.broadcast(known)
    rows = tokens.withColumn("ipa", strip_slashes(F.col("token"))).join(table, "ipa", "left")
    category = F.when(F.col("matches").isNull(), "phonological").when(F.array_contains("matches", F.col("ipa")), "direct").otherwise("notation-only")
    return rows.withColumn("category", category)


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def languages_of(rows: DataFrame, category: str) -> DataFrame:
    """``token, languages`` (sorted, joined) of one category."""
    return rows.where(F.col("category") == category).groupBy("token").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))


def stale(made: DataFrame, committed: DataFrame) -> bool:
    """Whether two artefacts differ in any row."""
    return not (made.exceptAll(committed).isEmpty() and committed.exceptAll(made).isEmpty())


def described(symbol: Column, ipa: Column) -> Column:
    """In words: the base glyphs, then in brackets the marks, then the tones, each in their order.

    A symbol is taken apart from its end: tone markers, then marks and tie bars wherever
    they stand; what is left are base glyphs. Marks that say the same are named once.
    """
    tones = F.regexp_extract(ipa, f"([{''.join(R.TONES)}]*)\\z", 1)
    body = F.substring(ipa, F.lit(1), F.length(ipa) - F.length(tones))
    bare = nfc(F.regexp_replace(body, f"[{''.join(R.MARKS)}\u0361]", ""))
    each = lambda text, table: F.array_compact(F.transform(F.split(text, ""), lambda c: lookup(table, c)))
    glyphs = F.filter(F.split(bare, ""), lambda c: c != "")
    first = lookup(R.GLYPHS, F.substring(bare, 1, 1))
    vowels = (F.size(glyphs) >= 2) & F.forall(glyphs, lambda c: F.coalesce(lookup(R.GLYPHS, c), F.lit("")).endswith("vowel"))
    known = F.filter(F.slice(glyphs, 2, F.greatest(F.size(glyphs), F.lit(1))), lambda c: c.isin(*R.GLYPHS))
    quote = F.when(ipa.contains("'") & ~ipa.contains('"'), '"').otherwise("'")
    base = (
        F.when(ipa.isin(*R.AFFRICATES), "Affricate")
        .when(vowels, F.concat(F.lit("Diphthong/triphthong ("), F.array_join(glyphs, " + "), F.lit(")")))
        .when(first.isNotNull(), F.array_join(F.concat(F.array(first), known), " + "))
        .otherwise(F.coalesce(lookup(R.ODD_SYMBOLS, symbol), F.concat(F.lit("Uncategorised symbol ("), quote, ipa, quote, F.lit(")"))))
    )
    named = lambda notes: F.when(F.size(notes) > 0, F.concat(F.lit("("), F.array_join(notes, ", "), F.lit(")")))
    return F.concat_ws(" ", base, named(F.array_distinct(each(body, R.MARKS))), named(each(tones, R.TONES)))


def read_phoneme_lists(spark: SparkSession, path: str, opens: str = "const L1_PHONEMES", closes: str = "};", split_bytes: int = 1 << 20) -> DataFrame:
    """``language, ord, token`` from the ``name: ["/a/", "/b/"],`` lines of a block of a text file; of repeated names the last holds.

    The block runs from a line that begins with ``opens`` to the next that is
    ``closes``; lines outside count for nothing, wherever the file was split.
    """
    from clipgrain.sources.blocks import block_lines

    pattern = r"^\s*([a-z_]+)\s*:\s*\[(.*)\]\s*,?\s*(?://.*)?$"
    lines = block_lines(spark, path, opens, closes, split_bytes)
    found = lines.where(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).alias("language"), F.regexp_extract("line", pattern, 2).alias("body"), "offset")
    last = found.groupBy("language").agg(F.max_by("body", "offset").alias("body"))
    return last.select("language", F.posexplode(F.expr("regexp_extract_all(body, '\"([^\"]+)\"', 1)")).alias("ord", "token"))


def symbols_of(tokens: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key, symbols, n_symbols``: the distinct symbols of each clip or file in code-point order."""
    return tokens.groupBy(key).agg(F.sort_array(F.collect_set("symbol")).alias("symbols")).withColumn("n_symbols", F.size("symbols"))


def read_vocab(spark: SparkSession, path: str, fallback: list[str] | None = None) -> DataFrame:
    """``symbol, idx`` of a JSON object of symbols and ids; where there is no such file, ``fallback`` or the fixed alphabet in order.

    Only a missing file is made up for: one that can't be read, or holds no such object, is an error.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>", {"mode": "FAILFAST"})).alias("symbol", "idx"))
        if found.isEmpty():
            raise ValueError(f"no symbols in {path}")
        return found
    return spark.createDataFrame(list(enumerate(fallback or [n.symbol for n in R.alphabet()])), "idx int, symbol string").select("symbol", "idx")


def write_artefacts(spark: SparkSession, folder: str, tokens: DataFrame) -> None:
    """The alphabet, the drift of ``tokens`` (``language, token``) by category, and its gaps, each as JSON lines."""
    found = drift(tokens)
    alphabet(spark).write.mode("overwrite").json(f"{folder}/alphabet")
    found.groupBy("category", "token").agg(F.sort_array(F.collect_set("language")).alias("languages")).write.mode("overwrite").json(f"{folder}/catalogue")
    languages_of(found, "phonological").write.mode("overwrite").json(f"{folder}/gaps")
