import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from rewardloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def agenda(library):
    return pieces.Agenda(library)


def ids(data):
    return [x for (x,) in struct.iter_unpack("<I", data)]


def test_the_agenda_gives_the_library_s_ids(agenda, library):
    rng = random.Random(7)
    texts = ["", " ", "   ", "a" * 5000, "中文字" * 300, "x▁y ▁ z", "▁" * 9, " " * 40 + "a" + " " * 17, "<s> </s> <unk> <0x0A>", "\n\n\t\r\x00", "é" * 200 + "́"]
    for letters in ("ab \n\t▁é中😀the", "  the of and", "lo we er.,​", "01 23\n"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(400)]
    assert [ids(x) for x in agenda.encode(texts)] == library.encode(texts)
    words = {part for t in texts for part in agenda.parts(library.normalize(t))}
    assert all(agenda.merged(part) == agenda.merged_short(part) for part in words if len(part) < 400)
    fresh = pieces.Agenda(library)
    fresh.learn(sorted(words))
    assert len(fresh) > 1000
    assert all(ids(x) == [i for piece in agenda.merged(part) for i in agenda.ids_of(piece)] for part, x in fresh.items())


def test_a_small_memory_and_uncut_texts_give_the_same_ids(library, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("the cat sat on a ") for _ in range(400)) for _ in range(50)]
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    few = pieces.Agenda(library)
    assert [ids(x) for x in few.encode(texts)] == library.encode(texts)
    assert len(few) <= 3 and len(few.before) <= 3
    whole = pieces.Agenda(library)
    whole.parts = lambda text: [text]
    whole.meet = {a + b for t in texts for a, b in zip(f"▁{t}".replace(" ", "▁"), t.replace(" ", "▁"), strict=False)}
    assert [ids(x) for x in whole.encode(texts)] == library.encode(texts)


def test_rows(spark, odd, library):
    found = pieces.encoded(odd, pieces.model(PATH)).collect()
    texts = [r.text or "" for r in odd.select("text").collect()]
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [ids(r.ids) for r in found] == want
    assert [r.n_tokens for r in found] == [len(x) for x in want]
    assert [r.decoded for r in found] == [library.decode(x) for x in want]
    assert all(r.agrees for r in found)
    assert [r.doc_id for r in found] == [r.doc_id for r in odd.select("doc_id").collect()]


def test_empty_table(empty):
    assert pieces.encoded(empty, pieces.model(PATH)).count() == 0


def test_the_query_equals_the_library(spark, library):
    import __spark_entry__ as driver

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in driver.queries()["op11_sentencepiece"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        x = library.encode(r.text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()
        assert got[r.doc_id] == (len(x), digest, hashlib.sha256(library.decode(x).encode()).hexdigest())


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    parsed = pb.ModelProto.FromString(open(PATH, "rb").read())
    parsed.trainer_spec.model_type = parsed.trainer_spec.UNIGRAM
    other = tmp_path / "other.model"
    other.write_bytes(parsed.SerializeToString())
    with pytest.raises(ValueError):
        pieces.model(str(other))


def test_unused_pieces_come_apart_and_letters_without_bytes_are_unknown():
    from sentencepiece import sentencepiece_model_pb2 as pb

    parsed = pb.ModelProto.FromString(open(PATH, "rb").read())
    for piece in parsed.pieces:
        if piece.piece in ("▁the", "an", "ing", "th"):
            piece.type = piece.UNUSED
    library = sentencepiece.SentencePieceProcessor(model_proto=parsed.SerializeToString())
    agenda = pieces.Agenda(library)
    texts = ["the man is singing to another banana in the morning", "then the thing"]
    assert [ids(x) for x in agenda.encode(texts)] == library.encode(texts)
