"""Quality rules, secret scans and byte-level BPE against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import op04_quality as quality
from marginalia.llm import op09_secrets as secrets
from marginalia.llm import op10_bpe as bpe

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a a a a", "é" * 30, "x " * 3000, "same line\nsame line\n\nsame line", "one\ttwo\u00a0three", "# * $ % & | < >", "a\x00b"]


def documents(spark, texts):
    """With a clashing extra column, a null id and repeated rows."""
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "y", 7), (None, "no id here", "z", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept long")


def covered(words, n):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}


def plain_quality(text, rules):
    text = text or ""
    words = WORDS.findall(text)
    chars = sum(map(len, words))
    seen, dup = set(), []
    for line in text.split("\n"):
        if WORDS.search(line):
            if line in seen:
                dup.append(line)
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeat = len(covered(words, 3))
    dup_chars = [sum(len(words[i]) for i in covered(words, n)) for n, _ in rules.coverage]
    line_chars = sum(len(w) for line in dup for w in WORDS.findall(line))
    failed = len(words) < rules.least_words or 100 * repeat > rules.repeat_words * len(words)
    kept = not failed and 100 * line_chars <= rules.dup_line_chars * chars and 100 * symbols <= rules.symbols * len(words)
    kept = kept and all(100 * d <= most * chars for d, (_, most) in zip(dup_chars, rules.coverage, strict=True))
    return (len(words), chars, symbols, len(dup), repeat, line_chars, dup_chars, failed, kept)


def test_quality_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "é", "b#", "longer", "x", "\n", "\t", "  ", "日本"]
    texts = ODD + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(60)] + [" ".join(str(rng.random()) for _ in range(80))]
    rules = quality.Rules()
    docs = documents(spark, texts)
    got = sorted((tuple(r)[0] if r[0] is not None else -1, tuple(r)[1:]) for r in quality.quality(docs).collect())
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], plain_quality(r["text"], rules)) for r in docs.collect())
    assert got == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, x in want if x[-1])


def test_empty_tables(spark):
    none = documents(spark, ["x"]).where("false")
    assert quality.quality(none).count() == 0
    assert quality.keep_good(none).count() == 0
    assert secrets.secrets(none).count() == 0
    assert secrets.mask(none).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans_equal_regexes(spark):
    rng = random.Random(1)
    bits = ["token", "secret", "=", ":", " ", '"', "'", "api_key", "apikey", "pass", "word", "passwd", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH1234", "deadbeef", "é", "\n", "Token", "API_KEY", "/", "-", ".", "ghp_", "\x00"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    docs = documents(spark, texts)
    found = secrets.digest(secrets.secrets(docs))
    by_text = {i: t for i, t in enumerate(texts)}
    for row in found.where("doc_id IS NOT NULL").collect():
        base = base_spans(by_text[row["doc_id"]] or "")
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))
    assert found.count() == docs.count()


def test_added_rules_and_mask(spark):
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "Zq" * 20 + " https://u:pa55word@host.example/x xoxb-1234567890-abc end"
    docs = spark.createDataFrame([(1, text, 99), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    spans = secrets.secrets(docs).where("doc_id = 1").first()["spans"]
    assert [s["kind"] for s in spans] == ["private_key", "github", "url_login", "slack"]
    assert text[spans[0]["start"] : spans[0]["end"]] == "-----BEGIN RSA PRIVATE KEY-----"
    masked = {r["doc_id"]: r for r in secrets.mask(docs).collect()}
    assert masked[1]["text"] == "é [secret] [secret] [secret]/x [secret] end"
    assert masked[1]["n_chars"] == len(masked[1]["text"])
    assert masked[2]["text"] == "clean" and masked[2]["n_chars"] == 5 and masked[3]["text"] is None


def test_automata_are_minimal():
    one = secrets.compile_rules([("ab|ab", False)], back=False, anywhere=False)
    assert one.states == 3
    with pytest.raises(ValueError):
        secrets.compile_rules([("a)b", False)], back=False, anywhere=False)


TOKENIZERS = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_tiktoken(name):
    tiktoken = pytest.importorskip("tiktoken")
    coder = bpe.bpe(TOKENIZERS.path(name), TOKENIZERS.PATTERN)
    peer = tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "a", "the", " the", "é", "ß", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "'s", "'S", "123", "\u0661", "!!", "日本語", "😀", "\u200b", "aaaaaaaa", "\r\n", "<|endoftext|>", "\x00", "ﬁ", "²", "_", "-"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    texts += ["ab" * 40_000 + "a" * 30_001, "é" * 20_000, "".join(rng.choices("abcdefgh", k=50_000))]
    want = [peer.encode_ordinary(t) for t in texts]
    for _ in range(2):  # new pieces, and remembered ones
        ids, n = coder.encode_texts([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    coder.forget()
    for text, ids in zip(texts, want, strict=True):
        assert coder.encode(text) == ids
        assert coder.decode(ids) == text.encode()


def test_bpe_pieces_with_one_hash(monkeypatch):
    """Where two pieces have one hash the bytes tell them apart."""
    coder = bpe.Bpe(bpe.load_ranks(TOKENIZERS.path("byte_bpe_50k.tiktoken")), TOKENIZERS.PATTERN)
    texts = [b"some words and some more", b"others", None, b"", b"words and others"]
    want = [x.tolist() for x in coder.encode_texts(texts)]
    coder.forget()
    monkeypatch.setattr(bpe.T, "hashes", lambda buf, begins, ends: (ends - begins).astype(np.uint64))
    assert [x.tolist() for x in coder.encode_texts(texts)] == want


def test_bpe_other_pattern():
    """A pattern with matches over white space isn't cut before it."""
    tokens = [bytes([b]) for b in range(256)] + [b"a b"[:2], b"b c"[1:]]
    coder = bpe.Bpe(tokens, r"\w+ \w+|\s+(?!\S)|\s+|.")
    assert bpe.fits(TOKENIZERS.PATTERN) and not coder.fits
    assert coder.encode("a b c") == [256, 98, 32, 99]


def test_bpe_round_trip(spark):
    docs = documents(spark, ODD)
    path = TOKENIZERS.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.round_trip(docs, path, TOKENIZERS.PATTERN)
    by_text = dict(enumerate(ODD))
    for r in rows.where("doc_id IS NOT NULL").collect():
        assert r["decoded_sha256"] == hashlib.sha256((by_text[r["doc_id"]] or "").encode()).hexdigest()
    assert rows.count() == docs.count()
    assert rows.where("false").count() == 0 and bpe.round_trip(docs.where("false"), path, TOKENIZERS.PATTERN).count() == 0
    assert bpe.encode(docs, path, TOKENIZERS.PATTERN).where(F.size("ids") == 0).count() == 2 + 1  # null (twice) and empty


def test_bitmap():
    rng = random.Random(4)
    bitmap, plain = bpe.Bitmap(70_000), set()
    for _ in range(3000):
        i = rng.randrange(70_000)
        if i in plain:
            bitmap.remove(i)
            plain.remove(i)
        else:
            bitmap.add(i)
            plain.add(i)
        assert bitmap.first() == (min(plain) if plain else -1)


def test_bpe_ranks_of_pairs_that_are_no_tokens():
    """Ids below zero (breaks, merged places) and pairs beyond the last have no rank, in one pass with pairs that have one."""
    coder = bpe.Bpe([bytes([b]) for b in range(256)] + [b"ab", b"\xff\xff"], r"(?s).+")
    assert len(coder.keys) == 3 and coder.keys[-1] == np.iinfo(np.int64).max
    left, right = np.array([97, -1, 97, -2, 255, 255, 257, -1]), np.array([98, 98, -1, -2, 255, 256, 257, 0])
    assert coder.rank_of(left, right).tolist() == [256, -1, -1, -1, 257, -1, -1, -1]
