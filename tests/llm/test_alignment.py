"""Cross-tokenizer alignment against a version that compares every token with every other one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from xancestry.llm import alignment, letters
from xancestry.llm.common import released

PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
DOCS = "doc_id long, text string, chunk string, `N_A` int, ids int"
TEXTS = [None, "", " ", "a", "  two  spaces ", "It's naïve: 中文 😀!", "bar ▁ piece", "<|endoftext|> </s> <s>", "tab\tline\n\n x", "12345 6.7", "word " * 4000, "x" * 5000, "The cat sat", "The cat sat", "\x00\x01é́"]
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(names):
    at, out = 0, []
    for k, b in names:
        out.append((at, at + len(b), k))
        at += len(b)
    return out


def by_hand(libraries, text):
    """(n_a, n_b, groups, links) of one text, or None."""
    t, s = libraries
    alphabet = alignment.byte_alphabet()
    if not text:
        return None
    a = [(k, bytes(alphabet[c] for c in t.id_to_token(k))) for k in t.encode(f" {text}", add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    b = [(k, piece(s.id_to_piece(k))) for k in s.encode(text)]
    if any(b"".join(x for _, x in side) != f" {text}".encode() for side in (a, b)):
        return None
    a, b = spans(a), spans(b)
    links = [(i, j) for x, y, i in a for u, v, j in b if x < v and u < y] if len(a) < 3000 else [(i, j) for (x, y, i), (u, v, j) in overlapping(a, b)]
    cuts, groups, low = sorted({y for _, y, _ in a} & {v for _, v, _ in b}), [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(k) for x, y, k in side if low <= x and y <= c) for side in (a, b)) if len(a) < 3000 else None)
        low = c
    return len(a), len(b), groups, links


def overlapping(a, b):
    j = 0
    for x in a:
        while b[j][1] <= x[0]:
            j += 1
        k = j
        while k < len(b) and b[k][0] < x[1]:
            yield x, b[k]
            k += 1


def expected(libraries, texts):
    found = [by_hand(libraries, t) for t in texts]
    held = Counter(p for f in found if f for p in set(f[3]))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        digest = None if f[2] and f[2][0] is None else hashlib.sha256(";".join(f[2]).encode()).hexdigest()
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(held[p] == top[p[0]] for p in f[3]), sum(held[p] for p in f[3]), digest))
    return out


def same(got, want):
    assert sorted(g[:-1] for g in got) == sorted(w[:-1] for w in want)
    assert {w[-1] for w in want} - {None} <= {g[-1] for g in got}


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 40, "batch_bytes": 10}])
def test_odd_texts(spark, libraries, sizes):
    rows = [(i, t, "c", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (3, "a", None, None, None)]
    out = alignment.align(spark.createDataFrame(rows, DOCS).repartition(3), *PATHS, with_groups=True, **sizes)
    got = out.collect()
    assert out.columns == ["doc_id", *FIGURES, "groups"]
    same([tuple(r[c] for c in FIGURES) for r in got], expected(libraries, [r[1] for r in rows]))
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)
    assert by_id[6]["n_links"] == 0 and by_id[12]["groups"] == by_id[13]["groups"] != "" and by_id[None]["n_a"] > 0
    released(out)
    empty = alignment.align(spark.createDataFrame([], DOCS), *PATHS)
    assert empty.columns == ["doc_id", *FIGURES] and empty.count() == 0


def test_a_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    out = alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), *PATHS, chunk_bytes=20_000)
    got = {r["doc_id"]: tuple(r[c] for c in FIGURES) for r in out.collect()}
    for d, want in zip(docs, expected(libraries, [d["text"] for d in docs])):
        assert got[d["doc_id"]][:-1] == want[:-1] and want[-1] in (None, got[d["doc_id"]][-1])


def test_rises_go_back():
    rng = np.random.default_rng(3)
    n = np.array([0, 4, 0, 0, 7, 1, 0])
    place = np.concatenate([np.sort(rng.choice(50, k, replace=False)) for k in n])
    assert (alignment._places(alignment._rises(place, n), n) == place).all()
    none = np.zeros(0, np.int64)
    assert len(alignment._places(alignment._rises(none, none), none)) == 0 and len(alignment._places(none, np.zeros(3, np.int64))) == 0


def test_classes_of_code_points():
    """Every code point is asked for: letters that one library doesn't know send a text to the library that the vocabulary belongs to."""
    a, b = letters.by_tiktoken(), letters.by_tokenizers()
    assert a[ord("a")] == b[ord("a")] == letters.LETTER and a[ord("7")] == letters.NUMBER and a[0xA0] == letters.SPACE
    assert letters.differing(a, a) == "(?!)"
    level = alignment.ByteLevel(open(PATHS[0], "rb").read(), P.PATTERN, "[z]")
    assert level.quick is not None
    for text in (" jazz it's 12", " jaunt it's 12 \n\n x"):
        assert level.encode(text, text.encode()).tolist() == level.tok.encode(text, add_special_tokens=False).ids
