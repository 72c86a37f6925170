import math
import random
import re
from collections import Counter

from deskflow.llm.quality import COUNTS, GAMMA, PRIOR, SPREAD, base_failed, judged, measured, thresholds


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts(spark, odd):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "é#", "\n", "c<", "\t", "the end\n"]) for _ in range(rng.randrange(80))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate([None, "", *texts])), "doc_id long, text string")
    for r in measured(df, keep=("doc_id",)).collect():
        assert tuple(r)[1:] == brute(None if r.doc_id == 0 else ["", *texts][r.doc_id - 1])
    assert len(judged(odd).collect()) == odd.count()


def test_verdicts_follow_their_group(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, " ".join(word(rng.randrange(3, 7)) for _ in range(60)), "en", "prose") for i in range(300)]
    rows += [(1000 + i, " ".join(word(rng.randrange(28, 34)) for _ in range(60)), None, None) for i in range(300)]
    rows += [(5000, " ".join(word(30) for _ in range(60)), "en", "prose"), (5001, " ".join(word(4) for _ in range(60)), None, None),
             (5002, " | ".join(word(4) for _ in range(60)), "en", "prose"), (5003, "too short", "en", "prose"),
             (5004, " ".join(word(5) for _ in range(60)), "en", "rare"), (5005, "one two three four five six seven eight " * 9, "en", "prose")]
    found = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i].kept for i in [*range(300), *range(1000, 1300)])
    assert found[5000].reasons == ["word_length"] == found[5001].reasons and not found[5000].kept
    assert found[5002].reasons == ["symbol_share"]
    assert found[5003].base_failed and not found[5003].kept and found[5005].base_failed
    assert found[5004].kept  # a small group is judged by its language


def test_limits_follow_the_tail_of_each_group(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(6))

    def text(n, again):  # n lines, of which the last ones repeat earlier ones, no two in a row
        lines = [line() for _ in range(n - again)]
        return "\n".join([*lines, *lines[: 2 * again : 2]])

    # one document in thirty repeats a line of twenty, in the other group one in five repeats two to four
    rows = [(i, text(20, 1) if i % 30 == 0 else text(20, 0), "en", "few") for i in range(300)]
    rows += [(1000 + i, text(20, rng.choice([2, 3, 4])) if i % 5 == 0 else text(20, 0), "en", "many") for i in range(300)]
    rows += [(5000, text(20, 3), "en", "few"), (5001, text(20, 3), "en", "many"), (5002, text(11, 4), "en", "many")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in judged(df).collect()}
    assert all(found[i].kept for i in [*range(300), *range(1000, 1300)])
    assert "line_share" in found[5000].reasons and found[5001].kept
    assert "line_share" in found[5002].reasons  # 4 of 11 lines, whatever the group
    assert found[5002].n_dup_lines == 4


def test_tail_within_junk_loosens_nothing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("%%%" if i < 30 else "") for _ in range(60)), "en", "a") for i in range(300)]
    found = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(("symbol_share" in found[i].reasons) == (i < 30) for i in range(300))


MEASURES = {  # value, what one occurrence adds, whether low values are judged
    "word_length": (lambda r: r.word_chars / r.n_words, lambda r: 0, True),
    "symbol_share": (lambda r: r.n_symbols / r.word_chars, lambda r: 1 / r.word_chars, False),
    "line_share": (lambda r: r.n_dup_lines / r.n_lines, lambda r: 1 / r.n_lines, False),
    "repeat_share": (lambda r: r.n_repeat_words / r.n_words, lambda r: 1 / r.n_words, False),
}


def edges(value):
    k = math.floor(math.log(value) / math.log(GAMMA)) if value else None
    return (0.0, 0.0) if k is None else (GAMMA**k, GAMMA ** (k + 1))


def exact_limits(rows, measure):
    value, unit, low = MEASURES[measure]
    values = sorted(map(value, rows))
    at = lambda q: edges(values[-(-q * len(values) // 100) - 1])
    (a, _), (_, b), (_, c), (_, d) = at(25), at(75), at(90), at(99)
    least = COUNTS * sum(map(unit, rows)) / len(rows)
    highs = [] if low else [1.0]
    if b > 0:
        highs.append(b + SPREAD * (b - a))
    if not low and d > c:
        highs.append(2 * d - c)
    for k in range(1, len(values)):
        x, y = edges(values[k - 1])[1], edges(values[k])[0]
        if 2 * k >= len(values) and y - x > x - a + least:
            highs.append((x + y) / 2)
            break
    return (a - SPREAD * (b - a) if low else None), min(highs)


def exact_blend(levels, measure):
    limits = (None, None)
    for rows in levels:  # overall, language, group
        if rows:
            w, own = len(rows) / (len(rows) + PRIOR), exact_limits(rows, measure)
            limits = tuple(x if y is None else y if x is None else w * x + (1 - w) * y for x, y in zip(own, limits))
    return limits


def mixed_corpus(rng, n):
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    for i in range(n):
        lang, source = [("en", "a"), ("en", "b"), ("de", "a"), (None, "rare")][min(rng.randrange(100) // 30, 3)]
        k = {"a": 5, "b": 8}.get(source, 6) + rng.randrange(-1, 2) * (rng.random() < 0.5)
        lines = [" ".join(word(k) for _ in range(6)) for _ in range(rng.randrange(5, 30))]
        kind = rng.random()
        if kind < 0.06:
            lines = [x.replace(" ", " %%|% ") for x in lines]
        elif kind < 0.08:
            lines = [x.replace(" ", "qqqqqqqqqqqqqqqqqqqqqqqq ") for x in lines]
        elif kind < 0.12:
            lines[-1] = lines[0]
        yield i, "\n".join(lines), lang, source


def test_verdicts_against_exact_quantiles_and_other_partitions(spark):
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(list(mixed_corpus(random.Random(12), 900)), schema)
    found = {r.doc_id: r for r in judged(df).collect()}
    assert found == {r.doc_id: r for r in judged(df.repartition(13)).collect()}
    rows = measured(df, keep=("doc_id", "lang", "source"), lines=True).withColumn("failed", base_failed()).collect()
    sound, blends = [r for r in rows if not r.failed], {}
    for r in rows:
        levels = [sound, [x for x in sound if x.lang == r.lang], [x for x in sound if (x.lang, x.source) == (r.lang, r.source)]]
        reasons = []
        for m, (value, _, _) in MEASURES.items():
            low, high = blends.setdefault((r.lang, r.source, m), None) or exact_blend(levels, m)
            blends[r.lang, r.source, m] = (low, high)
            if value(r) > high or (low is not None and value(r) < low):
                reasons.append(m)
        assert found[r.doc_id].reasons == reasons and found[r.doc_id].kept == (not r.failed and not reasons)
    assert {x for r in found.values() for x in r.reasons} >= {"symbol_share", "word_length"}
    assert 0.05 < sum(not x.kept for x in found.values()) / len(rows) < 0.2


def test_limits_move_steadily_with_the_group(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    rows = [(f"n{n}" if source else "big", " ".join(word(rng.randrange(6, 9) if source else rng.randrange(3, 7)) for _ in range(60)))
            for source, n in [(0, 400), *[(1, n) for n in (1, 10, 50, 199, 200, 201)]] for _ in range(n)]
    df = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    limits = {r.source: r.word_length_high for r in thresholds(measured(df, keep=("lang", "source"), lines=True), ("lang", "source")).collect()}
    assert max(limits[f"n{n}"] for n in (199, 200, 201)) - min(limits[f"n{n}"] for n in (199, 200, 201)) < 0.5


def test_clashing_names(odd_wide):
    assert judged(odd_wide).count() == odd_wide.count()


def test_empty(empty):
    assert judged(empty).count() == 0
    assert thresholds(measured(empty, keep=("doc_id", "lang", "source")), ("lang", "source")).count() == 0
