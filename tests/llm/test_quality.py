import re
from collections import Counter, defaultdict

from conftest import DOCS, words
from echolattice.llm import quality_classifier as qc
from echolattice.llm import quality_rules as qr
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(rows):
    hosts, lines = defaultdict(set), defaultdict(set)
    key = lambda x: " ".join(WORD.findall(x)).lower()
    for _, t, _, s, _ in rows:
        hosts[s].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines[s, key(x)].add(t or "")
    out = Counter()
    for i, t, _, s, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({p for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)})
        ls = [x for x in t.split("\n") if WORD.search(x)]
        n = sum(map(len, ls))
        gone = sum(len(x) for x in ls if (d := len(lines[s, key(x)])) > qr.LINE_DOCS and d > len(hosts[s]) * qr.LINE_SHARE)
        failed = len(w) < 50 or 100 * rep > 50 * len(w)
        out[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), rep, failed, not failed and not n - gone < qr.REMAIN * n] += 1
    return out


def test_rules(spark, docs, corpus, scratch, tmp_path):
    boiler = "All rights reserved by nobody in particular"
    more = [(5000 + k, f"{boiler}\n{boiler.upper()}  \nw{k} " + "x y z " * 5 if k % 2 else f"{boiler}\n" + " ".join(f"v{k}_{j}" for j in range(80)), "en", "src0", 1) for k in range(60)]
    site = "\n".join(" ".join(f"b{i}_{j}" for j in range(8)) for i in range(9))
    more += [(6000 + k, f"{site}\n" + " ".join(f"u{k}_{j}" for j in range(3)), "en", "src0", 1) for k in range(20)]
    rows = [*corpus, *more]
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(3)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = qr.op9_line_frequency(spark, str(tmp_path)).collect()
    want = plain_rules(rows)
    assert Counter(tuple(r) for r in got) == want
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)


def repeats(text):
    w = WORD.findall(text)
    wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    return len({p for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)})


def test_windows_of_one_hash(spark):
    """Hashes so narrow that unequal windows lie between equal ones."""
    import random

    rng = random.Random(2)
    texts = ["", "a", "a b", "a b c", "a b c a b c", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(80))) for _ in range(200))]
    texts += [words(rng, 600, 900) + " " + words(rng, 20, 3) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in (0, 1, 3, 64):
        got = {r["doc_id"]: r["n_repeat_words"] for r in qr.text_counts(df, ["doc_id"], bits).collect()}
        assert got == {i: repeats(t) for i, t in enumerate(texts)}


def test_windows_of_a_very_long_text(spark):
    """More words than the places of a short text hold, most of them repeated."""
    head = " ".join(f"w{k}" for k in range(90_000))
    text = head + " " + head + " x y z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert qr.text_counts(df, ["doc_id"]).first()["n_repeat_words"] == 180_000
    # of 30 bits that some 180,000 windows have, many are alike
    assert qr.text_counts(df, ["doc_id"], 30).first()["n_repeat_words"] == 180_000


def test_rules_plan_is_native(docs, scratch):
    plan = qr.text_counts(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_rows(no_docs, scratch, spark):
    assert qr.quality_rules(no_docs, scratch).count() == 0
    assert qc.classify(no_docs, spark.createDataFrame([], "doc_id long, quality int"), scratch).count() == 0


def test_classifier_on_held_out_labels(spark, scratch):
    """Fitted on half of the labels, held against the other half, as rejection and as ranking."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = qc.classify(docs, seen, scratch).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").select("quality", "kept", "score").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert len(good) > 100 and len(bad) > 10
    assert sum(r["kept"] for r in good) / len(good) > 0.98
    print(sum(r["kept"] for r in good) / len(good), sum(not r["kept"] for r in bad) / len(bad), sum(r["score"] < 0.5 for r in bad) / len(bad))
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.9
    assert sum(r["score"] < 0.5 for r in bad) / len(bad) > 0.97


def test_classifier_without_classes(spark, docs, scratch):
    labels = spark.createDataFrame([(5, 1), (8, 1), (None, 0), (11, None), (14, 7)], "doc_id long, quality int")
    got = qc.classify(docs, labels, scratch).collect()
    assert len(got) == docs.count() and all(r["kept"] and r["score"] is None for r in got)


def test_classifier_odd_rows(spark, corpus, scratch):
    import random

    rng = random.Random(1)
    junk = [(9000 + k, " ".join([f"w{k}"] * 60), "en", "src0", 200) for k in range(60)]
    rows = [*corpus, *junk, *((9500 + k, words(rng, 100), "en", "src0", 500) for k in range(60))]
    labels = [(9000 + k, 0, "x") for k in range(0, 60, 2)] + [(9500 + k, 1, "x") for k in range(0, 60, 2)] + [(9500, 1, "x"), (123456, 0, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("quality", F.lit("clash")).withColumn("t_upper", F.lit(1))
    got = qc.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"), scratch).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] is not None and 9000 <= r["doc_id"] < 9060)
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 9500)


def plain_scores(table, labels, rounds=3, sure=0.95, most=500):
    """Co-training over NumPy arrays: each view fitted by gradient descent with line search, calibrated on the rows kept back."""
    import numpy as np

    n_lang, n_source = qc.LANGS, qc.SOURCES
    keys = np.array([r["text_key"] for r in table])
    text = np.array([[r[f"t_{x}"] for x in qc._TEXT] for r in table])
    meta = np.array([[*np.eye(n_lang)[r["m_lang"]], *np.eye(n_source)[r["m_source"]], r["m_chars"]] for r in table])
    y = np.array([labels.get(r["doc_id"], -1) for r in table], float)
    known = {k for k, v in zip(keys, y, strict=True) if v >= 0}
    check = (y >= 0) & (keys % qc.HELD_OUT == 0)
    fitted = (y >= 0) & ~check
    pool = np.array([k not in known for k in keys])

    def logistic(x, y, weight, ridge):
        pen = np.array([ridge] * x.shape[1] + [1e-6])
        x = np.column_stack([x, np.ones(len(x))])
        cost = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + (pen * w * w).sum() / 2
        w = np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            slope = x.T @ (weight * (p - y)) + pen * w
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen) + 1e-12 * np.eye(len(w)), slope)
            size = 1.0
            while size > 1e-12 and cost(w - size * step) > cost(w):
                size /= 2
            if np.abs(size * step).max() < 1e-9:
                break
            w = w - size * step
        return w

    extra, odds = {"text": {}, "meta": {}}, {}
    for turn in range(rounds + 1):
        for name, x in (("text", text), ("meta", meta)):
            at = np.concatenate([np.flatnonzero(fitted), np.array([i for i, _ in extra[name].values()], int)])
            target = np.concatenate([y[fitted], [v for _, v in extra[name].values()]])
            weight = np.concatenate([np.ones(fitted.sum()), np.full(len(extra[name]), 0.5)])
            whole = [k for k in range(x.shape[1]) if name == "text" or k == x.shape[1] - 1]
            mean, dev = np.zeros(x.shape[1]), np.ones(x.shape[1])
            mean[whole], dev[whole] = x[at][:, whole].mean(axis=0), x[at][:, whole].std(axis=0)
            dev[dev < 1e-9] = 1
            z = (x - mean) / dev
            w = logistic(z[at], target, weight, 1.0)
            z = np.clip(z @ w[:-1] + w[-1], -30, 30)
            a, b = logistic(z[check][:, None], y[check], np.ones(check.sum()), 1e-3)
            p = np.clip(y[check].mean(), 1e-3, 1 - 1e-3)
            odds[name] = a * z + b if a > 0 else np.full(len(z), np.log(p / (1 - p)))
        if turn < rounds:
            bound = np.log(sure / (1 - sure))
            for name, other in (("text", "meta"), ("meta", "text")):
                z = odds[name]
                new = {}
                for sign, v in ((1, 1.0), (-1, 0.0)):
                    near = sorted({(-sign * z[i], keys[i]) for i in np.flatnonzero(pool & (sign * z >= bound))})[:most]
                    new |= {k: v for _, k in near}
                for k, v in new.items():
                    i = min(np.flatnonzero((keys == k) & pool), key=lambda i: table[i]["doc_id"])
                    extra[other][k] = (i, v)
    p = np.clip(y[check].mean(), 1e-3, 1 - 1e-3)
    return 1 / (1 + np.exp(-(odds["text"] + odds["meta"] - np.log(p / (1 - p)))))


def test_classifier_against_a_plain_one(spark, scratch):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    table = qc.views(docs).collect()
    want = {r["doc_id"]: s for r, s in zip(table, plain_scores(table, {r["doc_id"]: r["quality"] for r in labels.collect()}), strict=True)}
    got = {r["doc_id"]: r for r in qc.classify(docs, labels, scratch).collect()}
    assert set(got) == set(want)
    far = sorted(abs(got[i]["score"] - want[i]) for i in want)
    assert far[-1] < 0.01, far[-5:]
    assert sum(got[i]["kept"] != (want[i] >= qc.KEEP) for i in want) <= 1


def test_copies_of_labelled_texts_are_not_pseudo_labelled(spark, scratch):
    """A text that is kept back is wrong in its label; its copies under other ids change nothing."""
    import random

    rng = random.Random(8)
    rows = [(k, words(rng, 80) if k % 2 else " ".join([f"w{k}"] * 60), "en", "src0", 300) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    copies = [(1000 + k, rows[k % 100][1], "en", "src0", 300) for k in range(100)]
    one = {r["doc_id"]: r["score"] for r in qc.classify(spark.createDataFrame(rows, DOCS), labels, scratch).collect()}
    two = {r["doc_id"]: r["score"] for r in qc.classify(spark.createDataFrame(rows + copies, DOCS).repartition(7), labels, scratch).collect()}
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)
