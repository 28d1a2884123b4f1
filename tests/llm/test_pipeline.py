"""The stages of the corpus pipeline, each against a brute-force version of it, on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from xancestry.llm import bpe, langid, mixing, pii, queries
from xancestry.llm.common import exact, released

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Lang_Pred` string, fp string, mix_copy int, row int"
STAGES = dict(corpus_pipeline.STAGES)


def rows():
    body = [" ".join(f"{w}{k}" for k in range(60)) for w in ("the river house ", "le pont et la ", "der Fluss und das ", "zzz qq ")]
    out = []
    for i in range(80):
        text = (body[i % 4] if i % 8 < 4 else body[i % 4].replace("7", f" {i} x")) + (" mail me at jo@company.com or +1 555 234 5678, 25/12/2020" if i % 5 == 0 else f" word{i} " * (i % 3 * 20))
        out.append((i, text, (None, "en", "fr", "de")[i % 4], (None, "s1", "s0", "s2")[i % 4 if i % 9 else 1], len(text), "x", "y", 1, 2))
    odd = [None, "", " \n", "a", "12 34", "x" * 70_000, "word " * 20_000, "a\x1c\x85b c 😀"]
    out += [(100 + i, t, "en", "s1", 0, None, None, None, None) for i, t in enumerate(odd)]
    out += [out[3], out[3], (None, out[3][1], "de", "s2", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def plain(df):
    return sorted(map(str, df.collect()))


def test_language(spark, docs):
    got = STAGES["language ID"](spark, docs, None)
    pred = langid.with_language(docs, langid.train(langid.learnable(docs)), "text", "guess", "unsure")
    assert got.schema == docs.schema and plain(got) == plain(pred.where("guess <> 'und'").select(*map(exact, docs.columns)))
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(str(r[0]) for r in rows() if letters(r[1])), "documents with a letter stay, others go"


def test_near_duplicates(spark, docs):
    out = STAGES["near-duplicates"](spark, docs, None)
    got = out.collect()
    released(out)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    all_ = [(r[0], shingles(r[1])) for r in rows()]
    parent = list(range(len(all_)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(all_):
        for j, (_, b) in enumerate(all_[:i]):
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (k, _) in enumerate(all_):
        groups[root(i)].append(k)
    want = [min((k for k in g if k is not None), default=None) for g in groups.values()]
    assert out.schema == docs.schema and Counter(r["doc_id"] for r in got) == Counter(want) and len(want) < len(all_) - 10


def test_private_data(spark, docs):
    out, p = STAGES["pseudonyms"](spark, docs, None), pii.Pseudonyms(queries.DEMO_KEY)
    assert out.schema == docs.schema
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r[0], p.replace(r[1])[0]) for r in rows())
    assert not out.where("text like '%jo@company.com%' or text like '%25/12/2020%' or text like '%555 234 5678%'").count()


def test_mixture(spark, docs):
    out = STAGES["mixing"](spark, docs, None)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    released(out)
    plan = mixing.mix(docs, weights=(5, 2, 1), percent=150, epochs=2)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    took, want = Counter(), Counter()
    for (_, t), n in got.items():
        took[size(t)] += n
    for r in plan.collect():
        want[r["size"]] += r["repeats"]
    assert out.schema == docs.schema and took == +want and max(got[r[0], r[1]] / sum(x[:2] == r[:2] for x in rows()) for r in rows()) <= 2


def test_tokens(spark, docs):
    import tiktoken

    got = STAGES["tokens"](spark, docs, None).collect()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path(queries.BPE_FILE), "rb").read()), special_tokens={})
    want = Counter((r[0], hashlib.sha256(",".join(map(str, lib.encode_ordinary(r[1] or ""))).encode()).hexdigest()) for r in rows() if len(r[1] or "") < 50_000)
    assert len(got) == len(rows()) and not want - Counter((r["doc_id"], r["ids_sha256"]) for r in got)
    text = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert text == Counter((r["doc_id"], r["decoded_sha256"]) for r in got)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in got)
    assert 0 < len(got) and max(ids.values()) <= 2 and not {100, 101, 102, 104} & set(ids), "no document without a letter is left"
    docs.where(F.lit(False)).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_near_duplicates_by_simhash(spark):
    """Candidates of SimHash are those whose fingerprints hang together within its radius, and they are verified before any band is compared."""
    from itertools import combinations

    import numpy as np

    from xancestry.llm import common, minhash

    body = [f"w{k}" for k in range(3000)]
    texts = [" ".join(body[:i] + ["new"] + body[i:]) for i in range(0, 3000, 300)] + [" ".join(f"v{k}" for k in range(n)) for n in (3, 50, 52)] + [""]
    sets = list(map(minhash.shingles, texts))
    sims = list(map(minhash.simhash_of, sets))
    plain = [int(sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s.tolist()) > len(s))) for s in sets]
    assert [x % (1 << 64) for x in sims] == plain
    parent = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if (plain[i] ^ plain[j]).bit_count() <= minhash.RADIUS:
            parent = [parent[i] if p == parent[j] else p for p in parent]
    assert len(set(parent)) < len(texts) - 5
    pairs, least = minhash.close_fingerprints(spark.createDataFrame(list(enumerate(sims)), "node long, sim long"))
    found = {r["node"]: r["component"] for r in common.components(pairs).collect()}
    assert all((found.get(i, i) == found.get(j, j)) == (parent[i] == parent[j]) for i, j in combinations(range(len(texts)), 2))
    common.deleted(pairs, least)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, before = [], minhash.linked
    minhash.linked = lambda *a: asked.append(a[3][1].count()) or before(*a)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        out = minhash.one_of_each(docs)
        got = {r["doc_id"] for r in out.collect()}
        released(out)
    finally:
        minhash.linked = before
    assert asked[0] > 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    assert got == {min(j for j in range(len(texts)) if minhash.similarity(sets[i], sets[j]) >= 0.8) for i in range(len(texts))} and np.uint64(sims[-1]) == 0


def test_crowd_of_near_copies(spark, monkeypatch):
    """Copies that share bands but are edited too much to be alike aren't compared pair by pair, and those of them that are alike are found."""
    import random

    from xancestry.llm import common, minhash

    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]

    def edited(words, places):
        return [f"e{rng.random()}" if k in places else w for k, w in enumerate(words)]

    heavy = [edited(base, rng.sample(range(4, 146, 7), 5)) for _ in range(300)]
    twins = [edited(w, [rng.randrange(150)]) for w in heavy[:40]]
    light = [edited(base, rng.sample(range(150), k % 3)) for k in range(60)]
    texts = [" ".join(w) for w in heavy + twins + light]
    sets = list(map(minhash.shingles, texts))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and minhash.similarity(sets[i], sets[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    made, before = [], common.cut

    def counted(df):
        out = before(df)
        if df.columns == ["u", "v"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", counted)
    monkeypatch.setattr(common, "CROWD", 8, raising=False)
    out = minhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted(r["doc_id"] for r in out.collect())
    released(out)
    assert got == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values()) and 200 < len(got) < 350
    assert max(made) < 20 * len(texts), made


def test_pairs_in_turns(spark, monkeypatch):
    """Of a crowd's pairs those that hang together over earlier ones aren't verified, and components are those of all pairs."""
    from xancestry.llm import common

    monkeypatch.setattr(common, "MANY", 1000, raising=False)
    holds = F.pmod(F.xxhash64("u", "v"), F.lit(20)) == 0
    posted = spark.range(300).select(F.col("id").alias("node"), F.lit(7).cast("long").alias("key"))
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where(holds)

    _, met, used = common.linked(posted, verify)
    got = {r["node"]: r["component"] for r in met.collect()}
    common.deleted(*used)
    every = posted.select(F.col("node").alias("u")).join(posted.select(F.col("node").alias("v")), F.col("u") > F.col("v")).where(holds)
    want = {r["node"]: r["component"] for r in common.components(every).collect()}
    assert got == want and len(got) > 290
    assert sum(asked) < 20_000, asked
