import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.quality import QualityParams, base_counts, quality_rules, trusted_ids


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    "a b c a b c a b c",
    "x y z\nx y z\n \nx y z",
    "# * $\n\n|<>| && %",
    "a a a a",
    "a b c d e f g",
    "w " * 200,
    "p q r s p q r t p q r",
]


def test_base_counts_equal_brute_force(spark, odd, odd_rows):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for frame, texts in ((docs, TEXTS), (odd, [r[1] for r in odd_rows])):
        counted, name = base_counts(frame)
        got = sorted(map(tuple, counted.select(f"{name}.*").collect()))
        assert got == sorted(map(brute, texts))


def test_verdicts(spark, odd, labels):
    good = [(100 + i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(80))) for i in range(40)]
    bad = [(200 + i, " ".join(f"junk{(i * 5 + k * k) % 89}!!" for k in range(80))) for i in range(40)]
    rows = [(i, t, "en", "s") for i, t in good + bad]
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    )
    marks = spark.createDataFrame(
        [(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in bad[:30]], "doc_id long, quality int, toxic int"
    )
    scored, name = quality_rules(docs, marks)
    assert scored.columns == [*docs.columns, name]
    verdict = {r["doc_id"]: r for r in scored.select("doc_id", f"{name}.*").collect()}
    assert all(verdict[i]["kept"] for i, _ in good)
    assert not any(verdict[i]["kept"] for i, _ in bad)
    assert verdict[1]["base_failed"] and verdict[1]["score"] is None
    assert verdict[10]["base_failed"]  # long, but repeats itself


def test_clashing_columns_stay(odd, labels):
    scored, name = quality_rules(odd, labels)
    assert name not in odd.columns and scored.columns == [*odd.columns, name]
    assert scored.count() == odd.count()


@pytest.mark.parametrize("trusted", [0, 5])
def test_empty_table_and_no_labels(odd, labels, trusted):
    params = QualityParams(trusted_rows=max(1, trusted))
    scored, name = quality_rules(odd.limit(0), labels.limit(trusted), params)
    assert scored.count() == 0
    scored, name = quality_rules(odd, labels.limit(0), params)
    assert scored.where(~F.col(name)["base_failed"] & ~F.col(name)["kept"]).count() == 0


def test_threshold_rejects_bad_texts_with_ordinary_words(spark):
    """All good documents outside the fitted ones set the threshold, however few are fitted on; short ones do not."""

    def text(i, n, own, name):
        """Ordinary words, and a share ``own`` (per cent) of others."""
        r = random.Random(f"{name}{i}")
        words = [f"{name}{r.randrange(89)}" if r.random() * 100 < own else f"word{r.randrange(97)}" for _ in range(n)]
        return " ".join(words)

    good = [(i, text(i, 120, i % 8, "rare")) for i in range(300)]
    bad = [(1_000 + i, text(i, 120, 45, "junk###")) for i in range(40)]
    short = [(2_000 + i, text(i, 12, 70, "few")) for i in range(40)]
    docs = spark.createDataFrame(good + bad + short, "doc_id long, text string")
    marks = [(i, 1, 0) for i, _ in good + short] + [(i, 0, 0) for i, _ in bad[:20]]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for rows in (100, 20_000):
        scored, name = quality_rules(docs, labels, QualityParams(trusted_rows=rows))
        verdict = {r["doc_id"]: r for r in scored.select("doc_id", f"{name}.*").collect()}
        least = min(verdict[i]["score"] for i, _ in good)
        assert all(verdict[i]["score"] < least and not verdict[i]["base_failed"] for i, _ in bad)
        assert all(verdict[i]["kept"] for i, _ in good)
        assert not any(verdict[i]["kept"] for i, _ in bad)


def xx(*words):
    """Spark's hash of words, one seeding the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >> 63 else seed


def grams(text, buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [xx(*w) % buckets for w in [*zip(words), *zip(words, words[1:])]]


@pytest.mark.parametrize("buckets", [64, 16_384])
def test_scores_equal_brute_force(spark, odd, odd_rows, buckets):
    """The mean log ratio of hashed words and pairs, fitted on the trusted half by hash."""
    params = QualityParams(buckets=buckets)
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(100 + i, " ".join(f"w{(i * 7 + k * k) % (97 + i)}" for k in range(60 + i))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    fitted = {r.doc_id for r in trusted_ids(labels, params)[0].collect()}
    assert 0 < len(fitted) < 25
    raw = Counter(g for _, t in rows for g in grams(t, buckets))
    good = Counter(g for i, t in rows if i in fitted for g in grams(t, buckets))
    n, m = sum(raw.values()), sum(good.values())
    ratio = {
        b: round(math.log((good[b] + 1) / (m + buckets)) - math.log((raw[b] + 1) / (n + buckets)), 6)
        for b in range(buckets)
    }
    scored, name = quality_rules(docs, labels, params)
    got = scored.select("text", F.col(name)["score"].alias("score")).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [ratio[g] for g in grams(r.text, buckets)]
        assert r.score == (pytest.approx(sum(mine) / len(mine), abs=1e-9) if mine else None)
