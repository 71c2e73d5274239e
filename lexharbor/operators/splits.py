"""Splits, mixtures and sequence packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .prefix import running_sum
from .saved import saved

CUTOFF, EMBARGO, TEST_START = "1939-06-30", ("1939-07-01", "1939-08-31"), "1939-09-01"
HOLDOUT, VALIDATION, SEQUENCE, DECAY = 0.02, 0.02, 2048, 5.0
EPSILONS = (0.001, 0.005, 0.02, 0.1, 0.5)


def split(date: Column, key: Column) -> Column:
    """embargo, test (after the cutoff), or by bands of the key's hash fraction: holdout, validation, train."""
    d, h = date.cast("string"), T.hash_fraction(key)
    return F.when(d.between(*EMBARGO), "embargo").when(d >= TEST_START, "test").when(h < HOLDOUT, "holdout").when(h < HOLDOUT + VALIDATION, "validation").otherwise("train")


def exact_holdout(df: DataFrame, strata: list[str], key: str, fraction: float = HOLDOUT) -> DataFrame:
    """The lowest `fraction` of each stratum by hash, rounded up.  Rows are counted by the first 16 bits of their hash; all
    rows below the cell in which the count is reached stay, and only the rows of that cell are ranked."""
    cell = df.withColumn("_h", F.sha1(F.col(key))).withColumn("_c", F.substring("_h", 1, 4))
    counts = cell.groupBy(*strata, "_c").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*strata)
    at = counts.withColumn("_all", F.sum("_n").over(own)).withColumn("_before", F.coalesce(F.sum("_n").over(own.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    want = F.ceil(F.col("_all") * fraction)
    cut = at.where((F.col("_before") < want) & (F.col("_before") + F.col("_n") >= want)).select(*strata, F.col("_c").alias("_cut"), (want - F.col("_before")).alias("_left"))
    met = cell.join(cut, strata).where(F.col("_c") <= F.col("_cut"))
    ranked = met.where(F.col("_c") == F.col("_cut")).withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where(F.col("_k") <= F.col("_left"))
    return met.where(F.col("_c") < F.col("_cut")).select(*df.columns).unionByName(ranked.select(*df.columns))


def overlaps(df: DataFrame, key: str, label: str = "split") -> DataFrame:
    """Keys in more than one split; must be empty."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("n")).where("n > 1")


def recency_weight(df: DataFrame, year: str = "year", within: list[str] = (), last: int = 1939, decay: float = DECAY) -> DataFrame:
    """weight proportional to exp(-(last - year) / decay), summing to one within the keys: totals come from an aggregate."""
    w = df.withColumn("_w", F.exp((F.col(year) - last) / decay))
    if not within:
        total = w.agg(F.sum("_w").alias("_t"))
        return w.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_t")  # one row
    total = w.groupBy(*within).agg(F.sum("_w").alias("_t"))
    return w.join(total, list(within)).withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_t")


def fill_budget(df: DataFrame, order: str, size: str, budget: int, ties: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows in falling order as long as what stands before them is below the budget (of their keys)."""
    return running_sum(df, order, size, "before", ties, keys, descending=True).where(F.col("before") < budget)


def pack(df: DataFrame, order: str, size: str, length: int = SEQUENCE, ties: tuple[str, ...] = ()) -> DataFrame:
    """Concatenates documents, each with an end token, and cuts every `length` tokens: first and last sequence and the
    offset in the first."""
    own = df.withColumn("_s", F.col(size) + 1)
    at = running_sum(own, order, "_s", "start", ties)
    return at.select(*df.columns, "start", F.floor(F.col("start") / length).alias("first_seq"), F.floor((F.col("start") + F.col("_s") - 1) / length).alias("last_seq"), (F.col("start") % length).alias("offset"))


def epsilon_mix(base: DataFrame, other: DataFrame, key: str, n: int, epsilons=EPSILONS) -> DataFrame:
    """For each share: round(eps * n) rows of `other` and the rest of `base`, both of the lowest hashes.  The rank is a
    top-k, so each task sends n rows at most."""
    def lowest(df: DataFrame, part: str) -> DataFrame:
        top = df.select(key, F.sha1(F.col(key).cast("string")).alias("_h")).orderBy("_h", key).limit(n)
        return top.select(key, F.row_number().over(Window.orderBy("_h", key)).alias("_k"), F.lit(part).alias("part"))

    both = lowest(base, "base").union(lowest(other, "other"))
    want = F.when(F.col("part") == "other", F.round(F.col("epsilon") * n)).otherwise(n - F.round(F.col("epsilon") * n))
    return both.withColumn("epsilon", F.explode(F.array(*[F.lit(e) for e in epsilons]))).where(F.col("_k") <= want).select("epsilon", "part", key)


def pair_counts(docs: DataFrame, text: str = "text", most: int = 100) -> DataFrame:
    """Byte-pair counts of the first merge: neighbouring characters within words, weighted by the word's frequency.
    Words are counted before their pairs are made."""
    words = docs.select(F.explode(T.tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.col("w").substr(i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(most)


def learn_merges(docs: DataFrame, merges: int, text: str = "text") -> list[tuple[str, str]]:
    """BPE merges from word frequencies.  The pair counts of each round are an aggregation; only the best pair comes to
    the driver, and words are rewritten by a column expression."""
    words = docs.select(F.explode(T.tokens(F.col(text))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select("n", F.split("w", "(?!$)").alias("s"))
    out, words = [], saved(words)
    for i in range(merges):
        pairs = words.where(F.size("s") > 1).select("n", F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("p"))
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if best is None or best.n < 2:
            break
        a, b = best.a, best.b
        out.append((a, b))
        step = lambda acc, x: F.when((F.element_at(acc, -1) == a) & (x == b), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x)))
        words = words.select("n", F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.slice("s", 1, 1), step).alias("s"))
        if i % 8 == 7:
            words = saved(words)
    return out


def encode_merges(docs: DataFrame, merges: list[tuple[str, str]], keys: list[str], text: str = "text") -> DataFrame:
    """keys and the pieces of every text: its words in order, each with the merges applied best rank first.  A batch
    encodes each distinct word once."""
    ranks = {m: i for i, m in enumerate(merges)}

    @F.pandas_udf("array<string>")
    def pieces(words):
        known: dict[str, list[str]] = {}

        def one(word: str) -> list[str]:
            parts = list(word)
            while len(parts) > 1:
                rank, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
                if rank == len(ranks):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts

        return words.map(lambda ws: [p for w in ws for p in (known.get(w) or known.setdefault(w, one(w)))])

    return docs.select(*keys, pieces(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("pieces"))
