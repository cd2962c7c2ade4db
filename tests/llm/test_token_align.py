"""The alignment of two tokenizers against a plain version, on odd texts too."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sitelens.llm import token_align as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, and the dog.", "the the the the", "The quick brown fox, and the dog.", None, "", " ", "  two spaces  and trailing ", "line one\n\nline two\tand tab \n", "Zoë's naïve café à la carte", "日本語の テキスト です。", "emoji 😀 and 👩‍👩‍👧 family",
    "mark ▁ of a space", "<|endoftext|> <s> </s> <0x0A> <unk>", "ab" * 400, "a" * 999, "x y z 　w", "nul \x00 and \x1f end", "don't we'll it's", "12345 678 90,000.50", "\u0085   ​", "résumé é", "word " * 50, "-" * 300 + " " + "=" * 77,
]


def plain(texts):
    """The contract, written out: tokens, groups and links of each text one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    k = 0
    for x in range(256):
        if x not in shown.values():
            shown[chr(256 + k)] = x
            k += 1
    docs, holds = [], Counter()
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(shown[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        want = (" " + (text or "")).encode()
        if not text or b"".join(ta) != want or b"".join(tb) != want:
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        groups, x, y = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            p, q = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append((ia[x:p], ib[y:q]))
            x, y = p, q
        links = [(i, j) for g, h in groups for i in g for j in h]
        holds.update(set(links))
        docs.append((ia, ib, groups, links))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, groups, links = d
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows(frame):
    return [tuple(r)[1:] for r in sorted(frame.collect(), key=lambda r: (r.doc_id is None, r.doc_id))]


def test_matches_plain(spark):
    rng = random.Random(5)
    words = ["anthe", "tion", "Wherer,", "of", "ünd", "  ", "\n", "x" * 30, "ß", "不", "3.14", "a.b.c", "’s", "<0x41>", "é"]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain(texts)
    assert rows(T.align_tokenizers(frame, A, B)) == want
    # Blocks of a few texts each, and in other partitions: the same.
    assert rows(T.align_tokenizers(frame.repartition(5), A, B, block_bytes=200)) == want


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.align_tokenizers(empty, A, B).count() == 0
    odd = spark.createDataFrame([(None, "the cat", 1, 2), (7, "the cat", 3, 4), (7, "the cat", 3, 4), (None, None, None, None)], "doc_id int, text string, n_a int, pair int")
    got = T.align_tokenizers(odd, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    one = plain(["the cat"] * 3)[0]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted([one] * 3 + [(0, 0, 0, 0, 0, 0, "")])


@pytest.mark.parametrize("seed", range(20))
def test_align_finds_all_shared_cuts(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    ends, bounds = [], [[0], [0]]
    density = rng.choice([0.02, 0.3, 0.9])
    for side in range(2):
        cut = rng.random(n) < (density if side else 0.5)
        if seed % 3 == 0:
            cut = cut & (np.arange(n) % 2 == side)  # hardly a shared one
        cut[-1] = True
        cut[n // 2] = True  # two texts
        ends.append(np.flatnonzero(cut) + 1)
        bounds[side] += [int(np.searchsorted(ends[side], n // 2 + 1)) + 1, len(ends[side])]
    bounds = [np.array(b) for b in bounds]
    got = T.align(*ends, *bounds)
    shared = np.intersect1d(*ends)
    pa, pb = (np.concatenate([[0], np.searchsorted(e, shared) + 1]) for e in ends)
    assert got.tolist() == np.stack([pa[:-1], pa[1:], pb[:-1], pb[1:]], 1).tolist()


def test_many_links_by_counts():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 300), rng.integers(0, 40, 400)
    groups = np.array([[0, 200, 0, 250], [200, 300, 250, 400]])
    for at_once in (1 << 21, 64):
        row, pair, n = T.linked_pairs(groups, np.array([0, 1]), a, b, at_once)
        want = Counter((r, int(x) * T._PIECES + int(y)) for r, (s, e, p, q) in enumerate(groups) for x in a[s:e] for y in b[p:q])
        assert dict(zip(zip(row.tolist(), pair.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_each_different_stretch_is_aligned_once(monkeypatch):
    """A text's repeated words don't go through the alignment again: 4,000 tokens of either side before, those of 8 stretches now."""
    tokenizers, seen = T.TokenizerPair(A, B), []
    plain_align = T.align
    monkeypatch.setattr(T, "align", lambda ends_a, ends_b, *bounds: (seen.append(len(ends_a)), plain_align(ends_a, ends_b, *bounds))[1])
    texts = ["anthe tionwh, ouble ered. " * 300, "anthe ouble ered. " * 200]
    offsets = np.cumsum([0, *map(len, texts)])
    out = T._aligned_block(tokenizers, pa.array([1, 2]), 0, np.frombuffer("".join(texts).encode(), np.uint8), offsets, 0)
    assert [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for x in out.to_pylist()] == [(a, b, g, n, h) for a, b, g, n, _, _, h in plain(texts)]
    assert sum(seen) < 60


def test_few_known_stretches():
    """Ids come out the same when known stretches are dropped all the time, and for rows that are encoded whole."""
    rng = random.Random(8)
    words = ["anthe", "ouble,", "ünd", "不", "a▁b", "é", " ", "tion.", "\n", "x" * 40]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    want = plain(texts)
    for most in (2, 40, 250_000):
        tokenizers, got = T.TokenizerPair(A, B, most), []
        for k in range(0, len(texts), 7):
            part = pa.array(texts[k : k + 7], pa.string())
            for first, data, offsets in T.text_blocks(part):
                got += T._aligned_block(tokenizers, pa.array(range(len(part))), first, data, offsets, 0).to_pylist()
        assert [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for x in got] == [(a, b, g, n, h) for a, b, g, n, _, _, h in want]
