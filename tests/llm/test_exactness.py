"""Cases in which a shortcut of an encoder or scanner could go wrong, against the library or a plain version."""

import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from lexharbor.llm import common, pieces, secrets, tokenfiles


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate({97: "b", 98: "a"})
    return [word, word.translate({97: "b", 98: "a"})]


def odd_texts(seed=3, n=1500):
    r = random.Random(seed)
    marks = ["̀", "́", "̈", "̊", "̌", "̱", "̧", "͏", "‍"]
    plain = "AaBEehHJjTtYyIiſKÅÉéßİıΣσς12 .,'\n日本é😀"
    return ["".join(r.choice(marks) if r.random() < 0.3 else r.choice(plain) for _ in range(r.randint(0, 40))) for _ in range(n)]


HARD = ["H̱", "J̌ ", "xT̈y", "Y̊ and Y̊"] + [w for b in (10, 11, 12) for w in thue_morse(b)] + odd_texts()


def test_hash_of_words_is_by_content():
    words = HARD + [unicodedata.normalize("NFD", x) for x in HARD]
    raw = [w.encode() for w in words if w]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    h = common.spans_hash(buf, ends - [len(x) for x in raw], ends)
    by = {}
    for w, x in zip(raw, h.tolist()):
        by.setdefault(x, set()).add(w)
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(raw))


def encoded(enc, texts, limit):
    for c in common.chunks(pa.array(texts), limit):
        per, ids = enc.encode(c)
        at = np.concatenate([[0], np.cumsum(per)])
        yield from (ids[i:j].tolist() for i, j in zip(at, at[1:]))


@pytest.mark.parametrize("limit", [1 << 22, 4000])
def test_word_ids_of_hard_texts(limit):
    enc = tokenfiles.Encoder(common.tokenizer_file(tokenfiles.MODEL))
    for t, got, want in zip(HARD, encoded(enc, HARD, limit), enc.model.encode_batch(HARD, add_special_tokens=False)):
        assert got == want.ids, ascii(t)


def test_pieces_of_hard_texts():
    enc = pieces.PieceEncoder(common.tokenizer_file(pieces.MODEL))
    for t, got, want in zip(HARD, encoded(enc, HARD, 4000), enc.m.lib.encode(HARD)):
        assert got == want, ascii(t)


PLAIN = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def test_base_spans_of_random_texts():
    r = random.Random(5)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCD1234", "0a1b2c3d4e5f", "é", "İ", "ſecret", "toKen", "\n", "x+/_.=-y", "deadbeef"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        want = [(m.start(), 0, m.end()) for m in PLAIN["assign"].finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in PLAIN["access"].finditer(t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in PLAIN["hex"].finditer(t) if len(m[0]) >= 16]
        assert secrets.scan(t, secrets.Novelty())[0] == sorted(want), t


def plain_novel(text, base, novelty):
    """Every run within reach of every sensitive word, by definition; for runs up to SHORT characters."""
    low, out = text.lower(), set()
    for w in secrets.SENSITIVE:
        for m in re.finditer(re.escape(w), low):
            if any(x.start() <= m.start() and m.end() <= x.end() and x.span() != m.span() for x in secrets._WORD.finditer(low)):
                continue  # part of a longer word
            for run in re.finditer(r"[A-Za-z0-9+/_=.\-]{16,}", text[m.end() :]):
                s, e = m.end() + run.start(), m.end() + len(run[0].rstrip(".-")) + run.start()
                if run.start() > secrets.REACH:
                    break
                t = text[s:e]
                if e - s >= 16 and len(re.findall(r"[0-9]", t)) > 1 and re.search(r"[A-Za-z]", t) and not any(b[0] < e and s < b[2] for b in base) and novelty.of(text, s, e) >= secrets.NOVELTY:
                    out.add((s, 3, e))
    return sorted(out)


def test_novel_spans_of_random_texts():
    r = random.Random(6)
    key = lambda: "".join(r.choice("abcXYZ0123456789qwRT/+") for _ in range(r.randint(10, 40)))
    parts = ["secret", "the bearer is ", "token", "private key ", " ", " ", "\n", "word ", "_key_for_production ", "https://db.example.com/admin/path ", "deadbeefdeadbeef00", "= ", "..--"]
    novelty = secrets.Novelty()
    for _ in range(1500):
        t = "".join(key() if r.random() < 0.3 else r.choice(parts) for _ in range(r.randint(1, 14)))
        base, new = secrets.scan(t, novelty)
        if not any(len(x) > secrets.SHORT for x in re.split(r"[^A-Za-z0-9+/_=.\-]", t)):
            assert new == plain_novel(t, base, novelty), t


@pytest.mark.parametrize("text", ["token " * 350_000, "token" * 400_000, "secret9x" * 250_000, "deadbeefdeadbeef00 token " * 80_000, "password" + " " * 2_000_000, "token=" * 330_000, "token = \n" * 220_000])
def test_scan_is_linear(text):
    novelty = secrets.Novelty()
    began = time.time()
    secrets.scan(text, novelty)
    assert time.time() - began < 20


def test_learned_identifiers(spark):
    key = "x9QfT2mLr8VbZk4WcY7pHs3NdJ6gAe1U"
    build = "XBuildFrobnicatorStage2Runner2Handler"
    texts = [f"secret {key} for {w} is {build} in frobnicate_the_runner" for w in ("XBuildFrobnicator", "StageRunner", "XBuildFrobnicator StageRunner Handler")] * 40 + [None, "", "no word XBuildOther here", "token " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    learned = secrets.learn_identifiers(docs).removesuffix(secrets.IDENTIFIERS).split()
    assert {"XBuildFrobnicator", "StageRunner", "frobnicate_the_runner"} <= set(learned) and "XBuildOther" not in learned
    assert not any(x in key or x in build for x in learned if x not in ("XBuildFrobnicator", "StageRunner", "Handler"))
    assert secrets.learn_identifiers(docs, 1).removesuffix(secrets.IDENTIFIERS).split()[0] in texts[0]
    plain, primed = secrets.Novelty(), secrets.Novelty(secrets.learn_identifiers(docs))
    t = f"credential: {build} or {key}"
    of = lambda n, w: n.of(t, t.index(w), t.index(w) + len(w))
    assert of(primed, build) < of(plain, build) and of(primed, key) >= secrets.NOVELTY
    assert all(f"novel:{t.index(key)}:" in r.spans for r in secrets.find_secrets(docs).collect() if r.doc_id < 120 for t in [texts[r.doc_id]])
