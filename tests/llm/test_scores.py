"""Quality, toxicity, URL filter and the trees: held-out accuracy, rules by brute force, awkward rows."""

import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, documents, prose  # noqa: E402

from pageloom.llm import quality, toxicity, url_filter  # noqa: E402
from pageloom.llm.boosting import boost  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        w = prose(rng, rng.randrange(3, 120), 400)
        bad, rude = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            w = rng.choice([lambda: [x + "$$$" for x in w], lambda: [x.upper() + "!!" for x in w], lambda: [x for x in w for _ in range(9)]])()
        if rude:
            for x in rng.sample(["nitwitly", "oafishness", "dolt", "knaveries"], 2):
                w.insert(rng.randrange(len(w) + 1), x)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(not bad), int(rude)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("score, label, parts, part, line", [
    (quality.classify_quality, "quality", 3, 1, 0.5), (toxicity.classify_toxicity, "toxic", 4, 2, 0.3)])
def test_held_out_accuracy(corpus, score, label, parts, part, line):
    docs, labels = corpus
    out = {r.doc_id: r for r in score(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(out) == 1200
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % parts == part)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= line)
    held = [i for i in out if out[i].held_out]
    y, s = np.array([truth[i] for i in held]), np.array([out[i].score for i in held])
    assert auc(y, s) > 0.97
    assert (y == np.array([out[i].predicted for i in held])).mean() > 0.95


@pytest.mark.parametrize("score", [quality.classify_quality, toxicity.classify_toxicity])
def test_labels_of_the_held_out_fold_are_not_learnt(spark, corpus, score):
    docs, labels = corpus
    parts, part = (3, 1) if score is quality.classify_quality else (4, 2)
    turned = spark.createDataFrame(
        [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % parts == part else (i, q, t) for i, q, t in labels.collect()], LABELS)
    few = docs.limit(50)
    assert few.count() == 50
    one = sorted((r.doc_id, r.score) for r in score(docs, labels).collect())
    two = sorted((r.doc_id, r.score) for r in score(docs, turned).collect())
    assert one == two


@pytest.mark.parametrize("score", [quality.classify_quality, toxicity.classify_toxicity])
def test_awkward_rows(spark, corpus, score):
    _, labels = corpus
    docs = documents(spark, awkward())
    odd = labels.union(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 7, 7), (4, 1, 1), (4, 0, 0)], LABELS))
    for given in (odd, labels.limit(0), labels.filter("quality = 1 and toxic = 0")):
        out = score(docs, given).collect()
        assert len(out) == len(awkward()) and all(r.score is not None and 0 <= r.score <= 1 for r in out)
        assert not any(r.held_out for r in out if r.doc_id is None)
    assert score(documents(spark, []), labels).count() == 0


def test_quality_filter_keeps_columns_and_clean_rows(corpus):
    docs, labels = corpus
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    clean = {r.doc_id for r in labels.collect() if r.quality == 1}
    ids = {r.doc_id for r in kept.collect()}
    assert len(clean - ids) <= 0.02 * len(clean) and len(ids - clean) <= 0.05 * len(ids)


def test_pairs_of_terms_matter():
    """Two terms that are bad together only: the sum of single weights cannot tell, the machine can."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        texts.append(np.array([k for k, on in enumerate((a, b, True)) if on], np.int64))
        y.append(int(a == b))
    model = toxicity.learn_machine(np.arange(3), texts, np.array(y), rounds=600)
    p = model.probability([list(t) for t in texts])
    assert ((p > 0.5) == (np.array(y) == 1)).mean() > 0.95


def test_trees_learn_an_interaction_and_one_class():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((boost(x, y).probability(x) > 0.5) == y).mean() > 0.95
    assert boost(x, np.ones(2000)).probability(x[:2]).min() > 0.99
    assert boost(np.zeros((0, 3)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.NET/en/x", "http://example.net", "https://example.net/en/", "ftp://x.net/e?a=1",
    "http://badexample.net.org/fr/a", "http://org/fr/", "http://a.ORG/fr/?x#y", "http://example.com/de/a", "http://m.example.com/de",
    "http://xexample.com/de/", "http://a.com?x=http://b.net/", "http://É.net/", "http://a.net/\nb", "http://a.b.example.net/en/x/../y" * 3,
    "http://" + "a" * 5000 + ".net/" + "1" * 5000, "http://x.example.net/en/x", "http://x.example.net/en/x"]


def ruled(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(r), -k, v, r) for k, (v, r) in enumerate(url_filter.RULES)
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, (max(fits)[3] if fits else None), (max(fits)[2] if fits else None)


def test_rules_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 0.1) for i, u in enumerate(URLS)], "page_id long, url string, verdict string, score double")
    labels = spark.createDataFrame([], LABELS)
    out = url_filter.filter_urls(pages, url_filter.labelled_urls(pages, labels))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    for r in out.collect():
        host, path, rule, verdict = ruled(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame([], "url string, blocked int")).count() == 0


def test_url_trees_on_held_out_urls(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        name = "".join(rng.choice("abcdefgh0123456789-" if bad else "abcdefgh") for _ in range(rng.randrange(6, 25 if bad else 14)))
        rows.append((i, f"http://{name}.{rng.choice(['xyz', 'com'] if bad else ['com', 'edu'])}/{'a/' * rng.randrange(4)}{'?q=1&r=2' if bad else ''}", int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked int")
    out = {r.page_id: r.score for r in url_filter.filter_urls(df, df.filter("page_id % 2 = 0"), rules=()).collect()}
    held = [r for r in rows if r[0] % 2]
    assert auc(np.array([r[2] for r in held]), np.array([out[r[0]] for r in held])) > 0.97


def test_pairs_are_learnt_where_single_terms_say_nothing(spark):
    """Toxic exactly when both markers occur or neither: no term alone has a different share."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        found = prose(rng, rng.randrange(8, 30), 600) + ["lantern"] * one + ["bridge"] * two
        rng.shuffle(found)
        rows.append((i, " ".join(found), "s"))
        labels.append((i, None, int(one == two)))
    docs, truth = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r for r in toxicity.classify_toxicity(docs, truth).collect() if r.held_out]
    assert len(out) > 800 and sum((r.score >= 0.5) == bool(labels[r.doc_id][2]) for r in out) / len(out) > 0.9
