"""Every stage of the corpus pipeline, and run() itself, against plain versions."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, langid, mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = f"{DOCS}, coverage int, score double, lang_pred string, findings string, ids string, n_tokens int, offsets int, decoded string, _n int, _take int, size int, place int, _text_ string, fp string, component_id long"
MORE = (5, 0.5, "lp", "f", "i", 6, 7, "d", 8, 9, 10, 11, "t", "fp", 12)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def awkward(spark, documents):
    """Documents of the table beside nulls, empty texts, ties, repeated rows and columns named as the operators' own."""
    rows = [tuple(r) for r in documents.orderBy("doc_id").limit(60).collect()]
    rows += [(1000, None, None, None, None), (1001, "", None, "s", 0), (None, rows[0][1], "en", None, 3), rows[1], rows[1], (1002, "12345 !!", "en", "s", 8), (1003, rows[2][1] + " " * 20_000 + rows[3][1] * 30, None, "s", None)]
    return spark.createDataFrame([(*r, *MORE) for r in rows], CLASH)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_classes(rows):
    """Components of documents whose sets of shingles have a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_language_stage(spark, documents):
    for docs in (documents, awkward(spark, documents)):
        rows = [tuple(r) for r in docs.collect()]
        got = Counter(tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect())
        filters = langid.learn(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
        lang, _, coverage = filters.predict([r[1] for r in rows])
        assert got == Counter((*r[:2], k, *r[3:]) for r, k, c in zip(rows, lang, coverage) if k != "und" and c >= langid.LEAST_COVERAGE)
        assert not any(r[0] in (1000, 1001, 1002) for r in got)
    clean = [r for r in documents.collect() if r.lang in ("en", "de", "fr", "es") and len(r.text.split()) > 30]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, documents, "").collect()}
    assert sum(r.doc_id in kept for r in clean) >= 0.98 * len(clean)


def test_near_copies_stage(spark, documents):
    for docs in (documents, awkward(spark, documents)):
        rows = [tuple(r) for r in docs.collect()]
        named = {r[0]: r[1] for r in rows if r[0] is not None}
        least = near_classes(named.items())
        got = Counter(tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
        assert got == Counter(r for r in rows if r[0] is None or least[r[0]] == r[0])


@pytest.mark.parametrize("similarity", [0.70, 0.75, 0.795, 0.802, 0.82, 0.85, 0.90, 0.95])
def test_near_copies_stage_by_similarity(spark, similarity):
    """Pairs of 300 words: copies at 0.8 or more go, at a recall of 0.95 and from 0.82 on of 0.98; below nothing does."""
    rng = random.Random(int(similarity * 100))
    rows = []
    n = next(m for m in range(1, 200) if (300 - 4 - m) / (300 + 4 + m) <= similarity)  # changed words that lie together
    n -= similarity > 0.8
    for g in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        at = rng.randint(4, 300 - n)
        other = [*base[:at], *(f"v{rng.randrange(10**6)}" for _ in range(n)), *base[at + n :]]
        x, y = shingles(" ".join(base)), shingles(" ".join(other))
        assert abs(len(x & y) / len(x | y) - similarity) < 0.02 and (len(x & y) / len(x | y) >= 0.8) == (similarity > 0.8)
        rows += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(other), "en", "s", 1)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), "").count()
    assert kept == 240 if similarity < 0.8 else 120 <= kept <= 120 + (0.05 if similarity < 0.82 else 0.02) * 120, kept


def test_secret_stage(spark, documents):
    net = secrets.default_network()
    for docs in (documents, awkward(spark, documents)):
        rows = [tuple(r) for r in docs.collect()]
        want = Counter()
        for r, found in zip(rows, secrets.scan([r[1] for r in rows], net)):
            text, hidden = r[1], set()
            for _, s, e, _ in found:
                hidden |= set(range(s, e))
            if text is not None:
                text = re.sub("\0+", "[SECRET]", "".join("\0" if k in hidden else c for k, c in enumerate(text.replace("\0", " ")))) if hidden else text
            want[(r[0], text, *r[2:4], None if text is None else len(text), *r[5:])] += 1
        got = Counter(tuple(r) for r in corpus_pipeline.secret_scan(spark, docs, "").collect())
        apart = {k[0] for k in got - want}  # findings side by side get two masks, which the plain version runs together
        assert got == want or all(t.replace("[SECRET][SECRET]", "[SECRET]") in {x[1] for x in want if x[0] == i} for i, t, *_ in got if i in apart)


def test_mix_stage(spark, documents):
    for docs in (documents, awkward(spark, documents)):
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        rows, got = [tuple(r) for r in docs.collect()], [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
        taken = Counter()
        for r in mixing.mix(docs).collect():
            for n in (r.first, r.second):
                taken[r.doc_id, r.source, n] += n > 0
        assert Counter((r[0], r[3], size(r[1])) for r in got) == +taken
        assert sum(size(r[1]) for r in got) == int(1.5 * sum(size(r[1]) for r in rows)) and all(r[4] == len(r[1]) for r in got)
        whole = {(r[0], r[1], *r[2:4], *r[5:]) for r in rows}
        assert sum((r[0], r[1], *r[2:4], *r[5:]) not in whole for r in got) <= 1  # the cut falls in one document


def test_token_stage(spark, documents):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (documents, awkward(spark, documents)):
        got = corpus_pipeline.tokens(spark, docs, "").collect()
        assert all(r.exact and r.n_tokens == len(r.ids) // 4 for r in got)
        key = lambda x: str(x)
        want = sorted(((r.doc_id, r.lang, r.source, tuple(known.encode_ordinary(r.text or ""))) for r in docs.collect()), key=key)
        assert sorted(((r.doc_id, r.lang, r.source, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got), key=key) == want


def test_stages_of_nothing(spark, documents):
    empty = awkward(spark, documents).where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (stage is corpus_pipeline.tokens or out.columns == empty.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing sources", "byte-level BPE"]


def test_run_is_its_stages_one_after_the_other(spark, documents, small):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), stage(spark, docs, small).schema)
    before = len(common._WRITTEN)
    out = corpus_pipeline.run(spark, small)
    assert Counter(tuple(r) for r in out.collect()) == Counter(tuple(r) for r in docs.collect()) and out.count() > 100
    left = common._WRITTEN[before:]
    assert len(left) <= 2 and all(os.path.exists(p.removeprefix("file://")) for _, p in left)  # the last stage's input and its table


def test_shared_folder(spark, monkeypatch):
    assert common.shared_dir(spark).startswith("file:///")

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
