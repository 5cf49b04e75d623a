import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from riskspark.llm.bpe import content_cuts, encode_documents, encoder, repaired, split_chunks

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(TOKENIZER)
ODD = ["", " ", "\n", "a", "  lead", "trail  ", "a\n\n b", "it's we'll I'd\tx", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x y  z",
       "a\x1cb c\x1d d", "日本語のテキスト です", "😀 😀😀", "ab\r\n cd  ef", "1234 56 7,8.9", "....!!!! ???", "é" * 50, "́a ́", "0" * 3000]


def ids(text):
    return TOK.encode(text, add_special_tokens=False).ids


def test_encoder_and_decoder_agree_with_the_library():
    enc = encoder(TOKENIZER)
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab 1.\n\t'é日😀<|> ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, got in zip(ODD + mixed, enc.encode_many(ODD + mixed)):
        assert got.tolist() == ids(text), repr(text)
        assert enc.decode(got.tolist()) == TOK.decode(ids(text), skip_special_tokens=False)
    odd = [rng.randrange(50257) for _ in range(3000)]      # not valid UTF-8 everywhere
    assert enc.decode(odd) == TOK.decode(odd, skip_special_tokens=False)


def test_chunks_cover_and_realign(prose):
    a, b = prose(1, 3000), prose(2, 3000)
    starts, chunks = split_chunks(a)
    assert "".join(chunks) == a and len(chunks) > 3 and max(map(len, chunks)) <= 8192
    assert len(set(split_chunks(b[:777] + a)[1]) & set(chunks)) >= len(chunks) - 4      # shifted by 777
    assert content_cuts("z" * 50_000)[-1] == 50_000


def test_seams_are_repaired_wherever_they_fall():
    enc = encoder(TOKENIZER)
    rng = random.Random(4)
    for text in ["don't stop  now\n\nplease <|endoftext|> thanks 12345 " * 5, "é日本😀 " * 30, "longwordwithoutspace" * 20, *ODD]:
        for _ in range(20):
            cuts = sorted(rng.sample(range(len(text) + 1), min(5, len(text))))
            chunks = [c for c in (text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])) if c]
            if chunks:
                assert repaired(chunks, enc.encode_many(chunks), enc).tolist() == ids(text), (text, chunks)


def test_whole_table(docs, rows_of):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, TOKENIZER).collect()), key=repr)
    want = []
    for i, t in rows_of(docs):
        x = ids(t or "")
        want.append((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(),
                     hashlib.sha256(TOK.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_shared_chunks_are_reused_and_ids_kept(docs):
    out = {(r.doc_id, r.n_tokens): r for r in encode_documents(docs, TOKENIZER, keep_ids=True).collect()}
    assert any(r.n_reused for r in out.values())
    assert all(len(r.ids) == r.n_tokens for r in out.values())


def test_empty_table(empty):
    assert encode_documents(empty, TOKENIZER).collect() == []
