import os
import random
import zlib

import pytest

from docloom.llm.pieces import Codec, Pieces, encode_documents
from tests.llm.helpers import ODD, documents, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer model here")


def toy():
    texts = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "▁▁"]
    scores = [0.0] * 257 + [-3.0, -4.0, -5.0, -4.5, -6.0, -8.0, -13.0, -6.5, -9.0, -9.0, -7.0]
    return Pieces(texts, scores, [2] + [6] * 256 + [1] * 11)


def brute(pieces, word):
    """Best segmentation by trying all ends, the longest last piece among equals."""
    ids = {t: i for i, t in enumerate(pieces.texts) if pieces.kinds[i] == 1}
    unknown = min(pieces.scores[i] for i in ids.values()) - 10
    best = [(0.0, [])]
    for t in range(1, len(word) + 1):
        options = [(best[s][0] + pieces.scores[ids[word[s:t]]], -(t - s), best[s][1] + [ids[word[s:t]]]) for s in range(t) if word[s:t] in ids]
        if word[t - 1] not in ids:
            options.append((best[t - 1][0] + unknown, -1, best[t - 1][1] + [1 + b for b in word[t - 1].encode()]))
        score, _, path = max(options, key=lambda x: (x[0], -x[1]))
        best.append((score, path))
    return best[-1][1]


def test_against_brute_force():
    r = random.Random(6)
    pieces = toy()
    codec = Codec(pieces)
    texts = ["".join(r.choice("abcabc  xé") for _ in range(r.randint(0, 30))) for _ in range(300)]
    counts, ids = codec.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        own = ids[at : at + n].tolist()
        at += n
        assert own == (brute(pieces, ("▁" + text).replace(" ", "▁")) if text else [])
        assert codec.decode(own) == text


@needs_model
def test_library_agrees_on_the_scores_best_segmentation():
    import sentencepiece

    data = open(MODEL, "rb").read()
    at = data.rfind(b"\x18\x02 \x80\xfa\x01")  # the model type, which says BPE: the library is told to take the best sum of scores
    summed = data[:at] + b"\x18\x01" + data[at + 2 :]
    library = sentencepiece.SentencePieceProcessor(model_proto=summed)
    codec = Codec(Pieces.parse(summed))
    texts = ["Hello world, this is a sentence of words.", "tokenization unbelievably running", "Señor déjà vu Straße", "names and (signs)"]
    for text in texts:
        assert codec.encode([text])[1].tolist() == library.encode(text)


@needs_model
@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data here")
def test_length_is_near_the_library_s(spark):
    """Ranks of merges taken as frequencies: as many pieces as merging gives, within 3 %."""
    import sentencepiece

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(300).collect()]
    data = open(MODEL, "rb").read()
    counts, _ = Codec(Pieces.parse(data)).encode(texts)
    theirs = sum(map(len, sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts, num_threads=1)))
    assert abs(counts.sum() / theirs - 1) < 0.03


@needs_model
def test_documents(spark):
    rows = [(i, words(i, i % 60)) for i in range(200)] + [*ODD, (5, "x" * 20000), (6, "日本語 \t\r\n  ▁▁ \x00 z")]
    got = {(r.doc_id, r.decoded_crc32, r.n_tokens > 0, r.round_trip) for r in encode_documents(documents(spark, rows), open(MODEL, "rb").read()).collect()}
    assert got == {(i, zlib.crc32((t or "").encode()), bool(t), True) for i, t in rows}
    assert encode_documents(documents(spark, rows).limit(0), open(MODEL, "rb").read()).count() == 0
