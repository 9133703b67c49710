import hashlib
import random

import pytest

from lograil.llm.bpe import Codec, codec, encode_documents


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.path("byte_bpe_50k.json"))


PARTS = ["a", "the ", "  ", "\n", "é", "<|endoftext|>", "<|endo", "12", "'s", "ll", "中", "x", "\t", " zz", "!!", "\x1c", "　"]


@pytest.mark.parametrize("kind", range(4))
def test_tree_concatenation_equals_the_library(library, kind):
    rng, c = random.Random(kind), codec()
    for _ in range(60):
        if kind < 2:
            text = "".join(rng.choice(PARTS) for _ in range(rng.randint(50, 600)))
        elif kind == 2:
            text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(300, 3000)))
        else:
            text = rng.choice(["a", "ab", "é", " ", "\n ", "7", "中文"]) * rng.randint(100, 1500)
        want = library.encode(text, add_special_tokens=False).ids
        assert c.encode(text, leaf=40, window=8) == want
        assert c.decode(want) == library.decode(want, skip_special_tokens=False)


def test_window_inside_a_run_is_local():
    c, sizes = Codec(), []
    plain = c.encode_piece
    c.encode_piece = lambda text: sizes.append(len(text)) or plain(text)
    text = "".join(random.Random(5).choice("etaoinsh") for _ in range(20_000))
    assert c.encode(text, leaf=2000, window=64) == plain(text)
    assert max(sizes) <= 2000


def test_rows(spark, library):
    rows = [(1, "Hello <|endoftext|> wörld", "x"), (2, None, "y"), (3, "", None), (None, "a" * 70_000, "z")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert len(got) == 4
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by[doc_id].n_tokens == len(ids)
        assert by[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_meet_after_a_shuffle(spark, library):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 900))) for _ in range(25)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (0, texts[0]), (99, None)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), keep_ids=True, part=37).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in got))) == sorted(map(str, want))


def test_a_long_unsplit_text(spark, library):
    text = "".join(random.Random(4).choices("etaoinshrdlu", k=5_000_000))
    got = encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    ids = library.encode(text, add_special_tokens=False).ids
    assert [(r.n_tokens, r.ids_sha256) for r in got] == [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
