import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm.bayes import SiteParams, combine, site_quality


def strength(groups, above):
    g, n = len(groups), sum(len(x) for x in groups)
    if g < 2 or n <= g:
        return 1e6
    means = [sum(x) / len(x) for x in groups]
    inside = sum(sum(p * p for p in x) - sum(x) ** 2 / len(x) for x in groups) / (n - g)
    between = sum(len(x) * (m - a) ** 2 for x, m, a in zip(groups, means, above, strict=True)) / (g - 1)
    spread = (between - inside) / ((n - sum(len(x) ** 2 for x in groups) / n) / (g - 1))
    return min(1e6, max(1.0, inside / spread)) if spread > 0 else 1e6


def logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def brute(rows, keep):
    hosts, paths = {}, {}
    for _, host, path, p in rows:
        if p is not None:
            hosts.setdefault(host, []).append(p)
            paths.setdefault((host, path), []).append(p)
    all_ = [p for x in hosts.values() for p in x]
    rate = sum(all_) / len(all_)
    k = strength(list(hosts.values()), [rate] * len(hosts))
    q = strength(list(paths.values()), [sum(hosts[h]) / len(hosts[h]) for h, _ in paths])
    out = []
    for i, host, path, p in rows:
        mine, here = hosts.get(host, []), paths.get((host, path), [])
        top = (k * rate + sum(mine)) / (len(mine) + k) if here else rate
        low = (q * top + sum(here)) / (len(here) + q) if here else rate
        others = (q * top + sum(here) - p) / (len(here) - 1 + q) if p is not None else low
        odds = logit(rate if p is None else p) + logit(others) - logit(rate)
        out.append((i, round(top, 5), round(low, 5), round(1 / (1 + math.exp(-odds)), 5)))
    return sorted(out)


def test_posteriors_equal_brute_force(spark):
    rows = []
    for i in range(400):
        host = None if i % 11 == 0 else f"h{i % 5 if i % 3 else 0}"
        path = None if i % 7 == 0 else f"p{i % 3}"
        p = ((i * 37) % 100) / 200 + (0.4 if host == "h1" else 0.0) + (0.1 if path == "p2" else 0.0)
        p = None if i % 50 == 0 else p
        rows.append((i, host, path, p))
    rows.append((1_000, "alone", "x", None))
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    got = [
        (r.doc_id, round(r.host_posterior, 5), round(r.path_posterior, 5), round(r.probability, 5))
        for r in combine(scored, SiteParams()).collect()
    ]
    for a, b in zip(sorted(got), brute(rows, 0.2), strict=True):
        assert a == pytest.approx(b, abs=2e-5)


def test_held_out_accuracy(spark):
    places = F.sequence(F.lit(1), F.lit(80))
    good = F.transform(places, lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(200)).cast("string"))
    docs = spark.range(600).withColumnRenamed("id", "doc_id").withColumn("good", (F.col("doc_id") % 4 != 0).cast("int"))
    words = F.array_join(F.transform(good, lambda w: F.concat(w, F.when(F.col("good") == 1, "").otherwise("###"))), " ")
    docs = docs.withColumn("text", words).withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    labels = docs.where("doc_id < 300").select("doc_id", F.col("good").alias("quality"), F.lit(0).alias("toxic"))
    out = site_quality(docs.drop("good"), labels, F.col("source"), F.col("lang"))
    held = out.where("doc_id >= 300").join(docs.select("doc_id", "good"), "doc_id").collect()
    assert sum(r.kept == bool(r.good) for r in held) >= 0.97 * len(held)


def test_odd_rows(odd, odd_rows, labels):
    out = site_quality(odd, labels, F.col("source"), F.col("lang"))
    assert out.count() == len(odd_rows)
    assert site_quality(odd.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    without = site_quality(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {r.text_probability for r in without} == {0.5} and all(r.kept for r in without)


def test_sites_of_one_three_and_a_thousand_documents(spark):
    """A sparse site stays near the prior, a large one near its own rate, and a site can change a verdict."""
    def text(i, good, n=60):
        return " ".join(f"{(i * 31 + k * k) % 211}{'' if (k % 10 < (8 if good else 2)) else '##'}" for k in range(n))

    sites = [("bad.example", 1000, 0.05), ("good.example", 1000, 0.95), ("three.example", 3, 0.0), ("one.example", 1, 0.0)]
    rows, i = [], 0
    for host, n, share in sites:
        for j in range(n):
            good = (j % 100) / 100 < share
            rows.append((i, text(i, good), host, "a" if j % 2 else "b", int(good)))
            i += 1
    # The same doubtful text on a good and on a bad site.
    doubtful = " ".join(f"{k}{'##' if k % 2 else ''}" for k in range(60))
    rows += [(i, doubtful, "good.example", "a", None), (i + 1, doubtful, "bad.example", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, good int")
    labels = docs.where("good IS NOT NULL AND doc_id % 3 = 0").selectExpr("doc_id", "good AS quality", "0 AS toxic")
    out = {r.doc_id: r for r in site_quality(docs, labels, F.col("host"), F.col("path")).collect()}
    of = {host: [out[r[0]] for r in rows if r[2] == host] for host, _, _ in sites}
    rate = sum(r.text_probability for r in out.values()) / len(out)

    def shrunk(host):
        """How far a site's posterior has come from the global rate to its own mean."""
        mean = sum(r.text_probability for r in of[host]) / len(of[host])
        return (of[host][0].host_posterior - rate) / (mean - rate)

    assert shrunk("good.example") > 0.99 and shrunk("bad.example") > 0.99
    assert 0 < shrunk("one.example") < shrunk("three.example") < 0.99
    on_good, on_bad = out[i], out[i + 1]
    assert on_good.text_probability == on_bad.text_probability
    assert on_good.probability - on_bad.probability > 0.3
    assert on_good.kept and not on_bad.kept
