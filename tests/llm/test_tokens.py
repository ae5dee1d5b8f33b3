"""Token counts, pieces, packing and language scores against the libraries and brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.llm import language_id, packing, piece_codec, token_counts

PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "a", "the", "1", "é", "'s", "'ll", ".", "<|endoftext|>", "<s>", "▁", "日", "\U0001f600", "\x00", "ẞ", "\r"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 9))) for _ in range(n)] + ["", None, "word " * 4000]


def test_token_counts(docs, tokenizers_path):
    from tokenizers import Tokenizer

    texts, path = random_texts(1500, 1), tokenizers_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs(texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), t


def test_pieces_and_spans(docs, tokenizers_path):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    library, texts = sentencepiece.SentencePieceProcessor(model_file=path), random_texts(1500, 2)
    for r in piece_codec.encode_documents(docs(texts), path).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.decoded == library.decode(r.ids)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw
    for r in piece_codec.encode_digests(docs(texts[:50]), path).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_documents(tokenizers_path):
    """Own merges and decoding give what the library gives, on the documents and on single long words."""
    import pyarrow.parquet as pq
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    library, codec, r = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path), random.Random(9)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["".join(r.choice("abcdeorstn") for _ in range(5000)), "aaaa" * 500, " " * 300 + "x", "日本語" * 200, "a\x00b\u2581\u2581c \u2581"]
    for text in texts:
        ids, _, ends = codec.encode(text)
        assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)
        assert not ids or ends[-1] == len(text.encode())
    for _ in range(300):  # decoding of any ids, bytes that make no character among them
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_with_a_character_map(tmp_path, tokenizers_path):
    """The same model with a map that changes characters, and with and without squeezing of spaces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rules = sentencepiece_model_pb2.NormalizerSpec()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    for squeeze in (False, True):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(tokenizers_path("piece_bpe_32k.model"), "rb") as f:
            spec.ParseFromString(f.read())
        spec.normalizer_spec.precompiled_charsmap = rules.precompiled_charsmap
        spec.normalizer_spec.remove_extra_whitespaces = squeeze
        path = tmp_path / f"mapped{squeeze}.model"
        path.write_bytes(spec.SerializeToString())
        library, codec, r = sentencepiece.SentencePieceProcessor(model_file=str(path)), piece_codec.PieceCodec(str(path)), random.Random(4)
        for _ in range(600):
            text = "".join(r.choice([*PARTS, "ﬁ", "Ⅳ", "ｶ", "ﾞ", "½", "e\u0301", "word", " x"]) for _ in range(r.randint(0, 10)))
            ids, starts, ends = codec.encode(text)
            assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids), (squeeze, text)
            assert (starts <= ends).all() and (not ids or ends[-1] <= len(text.encode()))


def test_compiled_character_map():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normaliser.serialized_normalizer_spec())
    table, r = piece_codec.CharacterMap(spec.precompiled_charsmap), random.Random(3)
    for _ in range(500):
        text = "".join(r.choice([*PARTS, "ﬁ", "Ⅳ", "ｶ", "ﾞ", "½", "e\u0301"]) for _ in range(8))
        changed, at = table.apply(text.encode())
        assert changed.decode() == normaliser.normalize(text)
        assert len(at) == len(changed) + 1 and (np.diff(at) >= 0).all() and at[-1] == len(text.encode())


def test_packing_round_trip(docs, tokenizers_path):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    texts, library = random_texts(300, 4), sentencepiece.SentencePieceProcessor(model_file=path)
    packed = packing.pack(docs(texts), path, length=64)
    rows = packed.collect()
    for r in rows:
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.resets == r.cu_seqlens[:-1] and len(r.input_ids) == 256
    assert packing.unpack(packing.pack(docs([(4, "a b"), (4, "a b"), (None, "c"), (4, "d")]), path, length=2)).count() == 4
    back = {r.doc_id: r.ids for r in packing.unpack(packed).collect()}
    assert back == {i: ids for i, t in enumerate(texts) if (ids := library.encode(t or ""))}


def test_packing_of_null_and_repeated_ids(docs, tokenizers_path, monkeypatch):
    import sentencepiece

    path = tokenizers_path("piece_bpe_32k.model")
    library, text = sentencepiece.SentencePieceProcessor(model_file=path), "some words that stand in every row " * 5
    ids = library.encode(text)
    monkeypatch.setattr(packing, "SHARD_BYTES", 20 * len(text))
    texts = [(None, text)] * 100 + [(7, text)] * 100 + [(i, text) for i in range(100, 150)]
    rows = packing.pack(docs(texts), path, length=16).collect()
    assert sorted((d is None, d or 0) for r in rows for d, p in zip(r.doc_ids, r.parts) if p == 0) == sorted((d is None, d or 0) for d, _ in texts)
    assert sum(r.n_tokens for r in rows) == len(texts) * len(ids)
    back = packing.unpack(packing.pack(docs(texts), path, length=16)).collect()
    assert len(back) == len(texts) and all(r.ids == ids for r in back) and sum(r.doc_id is None for r in back) == 100
    held = {}
    for r in rows:
        held[r.shard] = held.get(r.shard, 0) + r.n_tokens
    assert len(held) == 13 and max(held.values()) < 3 * len(texts) * len(ids) / 13


def test_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(200):
        length = r.randint(1, 40)
        sizes = sorted((r.randint(1, length) for _ in range(r.randint(0, 80))), reverse=True)
        bins = []
        for x in sizes:
            if fitting := [b for b in bins if length - b >= x]:
                bins.remove(max(fitting))
                bins.append(max(fitting) + x)
            else:
                bins.append(x)
        assert sorted(sum(sizes[i] for i in row) for row in packing.best_fit_decreasing(sizes, length)) == sorted(bins)


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4}
    chances = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [1e-8]])
    edges = language_id.Lattice(pieces).edges(["ab"])
    total = language_id.forward(edges, 1, chances)[0, 3, 0]
    assert np.isclose(total, 0.1 * 0.3 * 0.05 + 0.1 * 0.15 + 0.2 * 0.05)
    back = language_id.backward(edges, np.array([3]), chances)[0, 0, 0]
    assert np.isclose(total, back)


def all_segmentations(word, pieces):
    """Every way to write a marked word as pieces or single characters."""
    if not word:
        return [[]]
    ways = []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            ways += [[word[:k], *rest] for rest in all_segmentations(word[k:], pieces)]
    return ways


def brute_model(texts, vocabulary):
    """Languages and a scoring function, by enumeration of segmentations and plain EM."""
    counts = {}
    for text, language in set(texts):
        for word in language_id.words_of(text):
            own = counts.setdefault(language, {})
            own[word] = own.get(word, 0) + 1
    pieces, chances = set(vocabulary), {}
    for language, own in counts.items():
        p = dict.fromkeys([*vocabulary, None], 1 / (len(vocabulary) + 1))
        value = lambda x, p=p: p[x if x in pieces else None]
        for _ in range(language_id.ROUNDS):
            expected = dict.fromkeys(p, 0.0)
            for word, n in own.items():
                ways = [(w, np.prod([p[x if x in pieces else None] for x in w])) for w in all_segmentations("▁" + word, pieces)]
                total = sum(c for _, c in ways)
                for w, c in ways:
                    for x in w:
                        expected[x if x in pieces else None] += n * c / total
            size = sum(expected.values()) + 1e-3 * len(p)
            p = {x: (e + 1e-3) / size for x, e in expected.items()}
        p[None] = 1e-8
        chances[language] = p
    names = sorted(chances)

    def score(text):
        words = language_id.words_of(text or "")
        if not words:
            return "und", 0.0
        logs = [sum(np.log(sum(np.prod([chances[x][y if y in pieces else None] for y in w]) for w in all_segmentations("▁" + word, pieces))) for word in words) for x in names]
        best = int(np.argmax(logs))
        return names[best], 1 / sum(np.exp(v - logs[best]) for v in logs)

    return score


def test_fit_and_scores_against_enumeration(spark, monkeypatch):
    vocabulary = ["▁", "▁a", "a", "ab", "b", "ba", "c", "ca", "▁c", "e\u0301", "abc"]
    monkeypatch.setattr(language_id, "fixed_vocabulary", lambda path: vocabulary)
    texts = [("ab abc ba a", "x"), ("ab abc ba a", "x"), ("ca ca cab bac z", "y"), ("acca CA e\u0301c", "y"), ("ba ab", None), (None, "x"), ("1 2", "x")]
    model = language_id.train(spark.createDataFrame(texts, "text string, lang string"), "")
    score = brute_model([t for t in texts if t[0] and t[1]], vocabulary)
    asked = ["ab ca", "AB ab zz", "e\u0301", "½ ² ① 12", "Ⅳ", "\u0301", "abcabcab " * 3, "", None, "cab\u0301a"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in language_id.identify(docs, model).collect():
        language, value = score(asked[r.doc_id])
        assert r.lang_pred == language and np.isclose(r.score, value), asked[r.doc_id]
    kept = language_id.keep_determined(docs.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(asked) if score(t)[1] > 0.5}


def test_long_words(tokenizers_path):
    """A word of any length is summed whole, in learning and in prediction."""
    vocabulary = language_id.fixed_vocabulary(tokenizers_path("piece_bpe_32k.model"))
    r = random.Random(6)
    word = "".join(r.choice("etaoinsh") for _ in range(25))
    model = language_id.fit({"a": {word: 2, "the": 3}, "b": {"le": 3, "q" * 400: 1}}, vocabulary)
    assert np.isfinite(np.log(model.chances)).all()
    lattice = language_id.Lattice(model.pieces)
    short = np.log(language_id.forward(lattice.edges([word]), 1, model.chances)[0, -1])
    assert np.allclose(short, language_id.long_sums(lattice.edges([word]), len(word) + 1, np.log(model.chances))[-1])
    share = language_id.long_expectations(lattice.edges([word]), len(word) + 1, np.log(model.chances[:, 0]))
    assert np.isclose((share * np.diff(lattice.edges([word])[:, 1:3], axis=1)[:, 0]).sum(), len(word) + 1)
    scorer = language_id.Scorer(model)
    languages, scores = scorer.predict([word * 2000, "q" * 500, "the", "q" * 500])
    assert languages == ["a", "b", "a", "b"] and all(0.5 < x <= 1 for x in scores) and all(len(w) <= 64 for w in scorer.places)


def test_held_out_accuracy(spark, tokenizers_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs.where(~held_out), tokenizers_path("piece_bpe_32k.model"))
    joined = language_id.identify(docs.where(held_out), model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(F.length("text") > 100)
    right, n = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


def test_undetermined(docs, tokenizers_path):
    model = language_id.fit({"en": {"the": 5}, "fr": {"le": 5}}, language_id.fixed_vocabulary(tokenizers_path("piece_bpe_32k.model")))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs([None, "", "123 !?", "the the"]), model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0.5 < got[3][1] <= 1


def test_batches_are_bounded_by_bytes(spark, tokenizers_path):
    """Documents reach Python a few megabytes at a time, however long they are; a bound that the session names stays."""
    key, wide = "spark.sql.execution.arrow.maxBytesPerBatch", F.concat(F.lit("the " * 12_500), "doc_id")
    model = language_id.fit({"en": {"the": 5}, "fr": {"le": 5}}, language_id.fixed_vocabulary(tokenizers_path("piece_bpe_32k.model")))
    docs = spark.range(300).toDF("doc_id").withColumn("text", wide).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    before = spark.conf.get(key, None)
    try:
        for ask in (language_id.keep_determined, language_id.identify):
            spark.conf.unset(key)
            assert ask(docs, model).count() == 300
            found = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in found) == 300 and max(r.size for r in found) < 5_000_000
        spark.conf.set(key, "1m")
        assert language_id.keep_determined(docs, model).count() == 300 and spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
