import collections
import random
import re

from pyspark.sql import functions as F

from deskflow.llm.collocations import collocations, score
from deskflow.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    dropped = set()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = lang, words[i : i + m]
                if 100 * a >= 80 * candidates[inner]:
                    dropped.add(inner)
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            cuts = [(f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
            s, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
            out[lang].append((-s, -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def told(df):
    return sorted(map(tuple, df.collect()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert told(QUERIES["op11_collocations"](spark, sf)) == brute(rows)


def made_up(seed):
    draw = random.Random(seed)
    words = ["a", "A", "b", "B", "é", "\x01", "c\x01", "dd", "the", "of", "x" * 50]
    rows = []
    for _ in range(300):
        text = "".join(draw.choice(words) + draw.choice([" "] * 6 + ["\t", "  ", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(draw.randint(0, 60)))
        rows.append((text, draw.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), ("the of " * 3000, "en")] + [("of a b c", "en")] * 40


def test_small_ranges_and_blocks(spark):
    rows = made_up(1)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("w1", F.lit(1)).withColumn("n", F.lit("x")).withColumn("word", F.lit(2)).repartition(4)
    assert told(collocations(df, rows=40, block=25)) == brute(rows)
    assert told(collocations(df, min_count=5, top=7, rows=1000, block=10)) == brute(rows, 5, 7)


def test_no_candidates(spark, odd, empty):
    assert told(collocations(empty)) == []
    # nothing is frequent but the word "x" of the long text
    assert [r[2:4] for r in told(collocations(odd))] == [("x x x x", 4997)]


def test_score_is_exact(spark):
    cases = [(30, 30, 30), (5 * 10**17, 10**18, 10**18 + 1), (9 * 10**18, 9 * 10**18, 1), (10**15, 3 * 10**15, 1)]
    df = spark.createDataFrame([(a, l + r) for a, l, r in cases if l + r < 2**63], "a long, s long").select("a", "s", score(F.col("a"), F.col("s")).alias("score"))
    assert all(r.score == 2000000 * r.a // r.s for r in df.collect())
