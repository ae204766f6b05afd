import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqsieve.llm import language_id, lm_scoring, mixing, pii
from seqsieve.llm.chat import rotate
from seqsieve.llm.language_id import identify
from seqsieve.llm.lm_scoring import backoff_scores
from seqsieve.llm.queries import MODEL_FILE, ORACLES

R = random.Random(9)
WORDS = ["the", "The", "of", "and", "to", "in", "é", "日本", "x|", "<|end|>"]
PROSE = lambda n: " ".join(R.choice(WORDS) + R.choice(["", "", "a", "b"]) for _ in range(n))

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for nth, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), nth, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


PII_TEXTS = [None, "", "a@b.c.d@e.f", "a@b.c_d@e.f x@y", "é🙂 me.you@ex-a.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255", "0000.0.0.0 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112", "4111  1111", "12345678901234567890123 4111111111111111", "+1 (017) 555-7713 +12 +1 2345 678 901 234 567 8", "++49 30 1234567", "1" * 3000, "a" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "+1" * 800, 'token = "04dbebab91ab85687d33eeaaf9ac699e"', "call (415) 555-0100 or ssn 123-45-6789", "mail joe (at) example (dot) com"]
PII_TEXTS += ["".join(R.choice("0123456789 -.+()@ab") for _ in range(R.randrange(120))) for _ in range(300)]


def test_pii_base_equals_regex(spark):
    df = spark.createDataFrame([(i, t, "own", None) for i, t in enumerate(PII_TEXTS)] * 2, "doc_id long, text string, kind string, value string")
    got = pii.find_pii(df).select("doc_id", "kind", pii.label(F.col("spans")).alias("spans")).collect()
    assert len(got) == 2 * len(PII_TEXTS)
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == base(PII_TEXTS[r.doc_id]), PII_TEXTS[r.doc_id]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_added_spans_and_redaction(spark):
    rows = [(i, f'the token = "{hashlib.md5(str(i).encode()).hexdigest()}" of user{i}@mail.example.com and no more') for i in range(40)] + [(99, None), (98, "plain words only")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3] == 'the token = "[SECRET]" of [EMAIL] and no more' and out[99] is None and out[98] == "plain words only"


def test_pii_of_texts_with_many_matches(spark):
    text = " ".join(f"u{i}@mail.example.com (213) 555-{i:04d}" + "é" * (i % 7) for i in range(1500)) + " é🙂" * 3000
    rows = [(1, text), (2, "a@b.c (213) 555-0000"), (3, "x" * 9000 + " me@mail.example.com " + "🙂" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weight = {"one": 1.0}
    found = {r.doc_id: r.spans for r in pii.find_pii(df, weight).collect()}
    assert len(found[1]) == 3000 and all(re.fullmatch(r"u[0-9]+@mail.example.com|\([0-9]{3}\) 555-[0-9]{4}", text[s.start : s.end]) for s in found[1])
    out = {r.doc_id: r.text for r in pii.redact(df, weight).collect()}
    assert out[1] == re.sub(r"\([0-9]{3}\) 555-[0-9]{4}", "[PHONE_LOCAL]", re.sub(r"u[0-9]+@mail.example.com", "[EMAIL]", text))
    assert out[2] == "[EMAIL] [PHONE_LOCAL]" and out[3] == "x" * 9000 + " [EMAIL] " + "🙂" * 9000


def test_pii_keeps_added_spans_off_base_ones(spark):
    rows = [(1, "tel (213) 555-0134@host.example.com"), (2, "ssn 219-09-9999 and 4111-1111-1111-1111")]
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), {"one": 1.0}).collect()}
    assert got == {1: [("email", 10, 35)], 2: [("ssn", 4, 15), ("card", 20, 39)]}


def test_em_finds_the_reliable_labeler():
    counts = [(0, (1, 1, 1), 300), (0, (1, 1, 0), 200), (0, (-1, -1, 0), 200), (0, (1, -1, 0), 15), (0, (-1, -1, 1), 20)]
    post = pii.em(counts)
    assert post[0, (1, 1, 1)] > 0.95 and post[0, (-1, -1, 0)] < 0.1
    weight = pii.train([(k, (*v, 1, 1), n) for k, v, n in counts])
    assert sum(weight.get(x, 0) for x in ("one", "kind0", "v0=1", "v1=1", "v2=1", "size=1", "made=1")) > 0


def sql(name, **tables):
    con = duckdb.connect()
    for t, table in tables.items():
        con.register(t, table)
    r = con.sql(ORACLES[name])
    return sorted(map(repr, (dict(sorted(zip(r.columns, row))) for row in r.fetchall())))


def same(df):
    return sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect())


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_backoff_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    rows = [(i, PROSE(R.randrange(60))) for i in range(60)] + [(7, "the of and"), (7, "the of and"), (None, "the of"), (61, None), (62, ""), (63, " \n"), (64, PROSE(3000))]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("own"))
    assert same(backoff_scores(df).withColumn("logprob", F.round("logprob", 3))) == sql("op4_lm_scoring", documents=table)
    assert backoff_scores(df.limit(0)).count() == 0


def test_every_n_gram_counts_without_a_cutoff(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 200)
    rows = [(i, PROSE(R.randrange(40)).lower()) for i in range(30)]
    count, words, want = collections.Counter(), 0, {}
    for _, t in rows:
        w = t.split()
        words += len(w)
        count.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for i, t in rows:
        w, total = t.split(), 0.0
        for at in range(len(w)):
            k = min(3, at + 1)  # every n-gram of a document was counted, so none backs off
            total += math.log(count[tuple(w[at - k + 1 : at + 1])] / (count[tuple(w[at - k + 1 : at])] if k > 1 else words))
        want[i] = total
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.logprob for r in backoff_scores(df, min_count=1).collect()} == pytest.approx(want)


def test_lower_orders(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id long, text string")
    got = {r.doc_id: r.logprob for r in backoff_scores(df, 1).collect()}
    assert got[2] == pytest.approx(math.log(3 / 6) + math.log(1 / 6))
    got = {r.doc_id: r.logprob for r in backoff_scores(df, 2).collect()}
    assert got[2] == pytest.approx(math.log(3 / 6) + math.log(0.4) + math.log(1 / 6))


def fill(size):
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode())))}
    fixed, total = {}, 1.5 * sum(size.values())
    while True:
        rest = [s for s in size if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > 2 * size[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in rest}
        fixed |= {s: 2 * size[s] for s in over}


def test_mixing(spark):
    rows = [(i, R.choice(["a", "a", "a", "b", "ü", "z", None]), PROSE(R.randrange(1, 40))) for i in range(900)] + [(1000, "empty", None), (1001, "empty", ""), (1002, "b", PROSE(4000)), (None, "a", "x y"), (5, "a", "dup dup"), (5, "a", "dup dup")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("at", F.lit(1))
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect())) and len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for i, s, t in rows:
        size[s] += len((t or "").split())
    source = {(i, len((t or "").split())): s for i, s, t in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size and r.source_size == size[s]
    want = fill(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(12, 0.02 * want[s], max(len((t or "").split()) for _, o, t in rows if o == s) / 2), s
    copies = collections.Counter((r.doc_id, r.source) for r in mixing.mixed(df).collect())
    assert sum(len((t or "").split()) * copies[i, s] for i, s, t in rows if i not in (5, None)) == sum(r.taken for r in got if r.doc_id not in (5, None))
    assert mixing.mix(df.limit(0)).count() == 0


def test_chat_equals_sql(spark):
    rows = [(c, t, R.choice(["ann", "bob|>", "eve", None]), R.choice([PROSE(5), "", None, "a <|end|> b"])) for c in (1, 2, None) for t in range(R.randrange(3, 150))] + [(9, 0, "solo", "x"), (9, 0, "solo", "x"), (9, None, "late", "y"), (9, None, "late", "y")]
    rows += [(10, 5, R.choice(["ann", "eve"]), PROSE(3)) for _ in range(700)] + [(10, 70, "ann", "same")] * 600 + [(None, None, None, None)] * 2
    table = pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate({"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}.items())})
    out = rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("own")))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    got = out.select("conv_id", "speaker", "chunk", "piece", "n_turns", "rendered", spans.alias("mask_spans"))
    assert same(got) == sql("op6_chat_rotation", conversations=table)
    for r in out.collect():
        for m in r["mask"]:
            assert r["n_turns"] < 400 and r["rendered"][m["start"] : m["end"]].endswith("<|end|>\n") and r["rendered"][: m["start"]].endswith("<|assistant|>\n")
    assert out.limit(0).count() == 0


TEXTS = ["", "  a  b\n c", " ", " x", "a ", "日本語 テキスト🙂", "a" * 300, "\x00a b\x00", "\u2581x \u2581\u2581y", "   " * 20 + "if x:\n\t return  1", "ﬁ e\u0301\u200b", "the" * 200 + " end", None] + ["".join(R.choice("ab the\n .é日ß") for _ in range(R.randrange(200))) for _ in range(200)]


@pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")
@pytest.mark.parametrize("index,known", [(500_000, 400_000), (50, 100)])
def test_sentencepiece_equals_the_library(spark, monkeypatch, index, known):
    import sentencepiece

    from seqsieve.llm import sentencepieces as S

    monkeypatch.setattr(S, "INDEX", index)
    monkeypatch.setattr(S, "KNOWN", known)
    model, pieces, memory = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE), S.Pieces(MODEL_FILE), S._Memory()
    for _ in range(2):
        flat, at = S.encode_texts(pa.array(TEXTS, pa.string()), pieces, memory)
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t or "") for t in TEXTS]


@pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")
def test_sentencepiece_round_trip(spark):
    from seqsieve.llm.sentencepieces import decode, encode, ids

    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, tokens string")
    for r in decode(encode(df, MODEL_FILE), MODEL_FILE).withColumn("ids", ids()).collect():
        assert r.decoded == (r.text.replace("\u2581", " ") if r.text is not None else None)
        assert r.n_tokens == len(r.tokens or b"") // 4 and (r.tokens is None or r.ids == np.frombuffer(bytes(r.tokens), "<i4").tolist())
    assert encode(df.limit(0), MODEL_FILE).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")
@pytest.mark.parametrize("index", [200_000, 700])
def test_sentencepiece_of_long_units_and_any_ids(monkeypatch, index):
    import sentencepiece

    from seqsieve.llm import sentencepieces as S

    monkeypatch.setattr(S, "INDEX", index)
    model, pieces, memory = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE), S.Pieces(MODEL_FILE), S._Memory()
    spoken = [model.id_to_piece(i).replace(S.SPACE, "") for i in range(300, 32000)]
    texts = ["".join(chr(R.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "的一是不了人我在有他这为之大" * 200, "a" * 5000, "ab" * 700, "日本語の文章です。" * 300 + " x", "".join(R.choice(spoken) for _ in range(800))]
    flat, at = S.encode_texts(pa.array(texts), pieces, memory)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t) for t in texts]
    for _ in range(300):
        ids = [R.choice([R.randrange(300), R.randrange(32000), 0, 1, 2]) for _ in range(R.randrange(9))]
        assert S.decode_texts(np.array(ids, np.int64), np.array([0, len(ids)]), np.array([True]), pieces)[0].as_py() == model.decode(ids), ids


@pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")
def test_sentencepiece_takes_bpe_over_unchanged_text_only(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    from seqsieve.llm.sentencepieces import Pieces

    for change in ("m.trainer_spec.model_type = 1", "m.normalizer_spec.remove_extra_whitespaces = True", "m.normalizer_spec.add_dummy_prefix = False"):
        m = proto.ModelProto()
        with open(MODEL_FILE, "rb") as f:
            m.ParseFromString(f.read())
        exec(change)
        (tmp_path / "m.model").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError, match="cannot be encoded"):
            Pieces(str(tmp_path / "m.model"))


SYLLABLES = {"en": "the of and ing tion er".split(), "de": "der und ein schen keit ü".split(), "fr": "le que ment eux é ou".split()}


@pytest.mark.parametrize("sample", [2048, 60])
def test_language_id(spark, monkeypatch, sample):
    monkeypatch.setattr(language_id, "SAMPLE", sample)
    rows = []
    for i in range(600):
        lang = R.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(R.choice(SYLLABLES[lang]) for _ in range(R.randrange(1, 4))) for _ in range(30)), lang))
    rows += [(700, None, "en"), (701, "", "en"), (702, "12 34 !!", "de"), (703, "x", None), (704, "the ing " * 20000, None), (None, "der und keit ein", None), (3, rows[3][1], rows[3][2])]
    out = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)))
    got = out.collect()
    assert len(got) == len(rows)
    truth, right = {i: lang for i, _, lang in rows}, []
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (700, 701, 702):
            assert r.lang_pred == "und"
        elif r.held_out and truth[r.doc_id]:
            right.append(r.lang_pred == truth[r.doc_id])
    assert len(right) > 100 and sum(right) / len(right) > (0.97 if sample > 60 else 0.9)
    assert {r.doc_id: r.lang_pred for r in got}[704] == "en"
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, PROSE(80) + f" user{i}@mail.example.com", "en", R.choice(["a", "b", None]), 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a", 0), (101, "1 2 3", "en", "a", 0), (102, None, None, "a", 0), (103, rows[1][1] + " more", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{nth}")
        before, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{nth}")
        assert docs.columns == before
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert set(range(104)) & {r[0] for r in rows} - set(seen[0]) == {101, 102}
    assert set(seen[0]) - set(seen[1]) == {100, 103} and seen[2] == seen[1] and set(seen[3]) <= set(seen[2])
    assert docs.where("text like '%@%'").count() == 0
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == seen[3] and all(r.round_trip and r.n_tokens for r in last)


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    near = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 86 of 106 shingles: 0.811
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, PROSE(80))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


@pytest.mark.skipif(not os.path.exists(MODEL_FILE), reason="no model file")
def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage but the fitted decisions; an empty table; null ids, repeated rows, clashing columns."""
    import corpus_pipeline
    import sentencepiece

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, row string, tiles long"
    prose = lambda n: " ".join(R.choice(WORDS) + str(R.randrange(40)) for _ in range(n))
    rows = [(i, f"{prose(40)} mail user{i}@mail.example.com or +49 (30) 1234-{1000 + i} then 10.0.0.{i}", R.choice(["en", "de", None]), R.choice(["a", "a", "b", None])) for i in range(50)]
    rows += [(60, rows[3][1], "en", "a"), (61, rows[4][1] + " end", "en", "b"), rows[7], rows[7], (8, prose(50), "en", "b"), (None, rows[9][1], "en", "a"), (None, "abc", None, None), (70, "", "en", "a"), (71, None, "en", "a"), (72, "7 8", "en", "a"), (73, "ab " * 9000, "en", "z")]
    rows = [(*r, len(r[1] or ""), "k", "s", "r", 5) for r in rows]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    letters = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    ids = {}
    for r in letters:
        if r[0] is not None:
            w = r[1].lower().split()
            ids.setdefault(r[0], []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    gone = {a for a in ids for b in ids if b < a for x in ids[a] for y in ids[b] if 100 * len(x & y) >= 80 * len(x | y)}
    kept = [r for r in letters if r[0] is None] + [min((r for r in letters if r[0] == i), key=lambda r: r[1]) for i in ids if i not in gone]
    assert gone == {60, 61}
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    docs = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.identify_language(spark, docs, ""), "")
    assert sorted(map(str, docs.collect())) == sorted(str(r) for r in spark.createDataFrame(kept, schema).collect()) and docs.columns == schema.replace("long", "").replace("string", "").replace(" ", "").split(",")

    def clean(text):
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in base(text))]
        out, at = "", 0
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        return out + text[at:]

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    want = {(r[0], clean(r[1])): r for r in kept}
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    copies, size, taken, target = collections.Counter(), collections.Counter(), collections.Counter(), {}
    for r in got:
        tokens = np.frombuffer(bytes(r.tokens), "<i4").tolist()
        text = model.decode(tokens)
        assert (r.doc_id, text) in want and tokens == model.encode(text) and r.round_trip and r.n_tokens == len(tokens)
        copies[r.doc_id, text] += 1
        taken[r.source] += len(text.split())
    for (_, text), r in want.items():
        size[r[3]] += len(text.split())
    target = fill(size)
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= max(30, max(len(t.split()) for (_, t), r in want.items() if r[3] == s) / 2) for s in size), (taken, target)


def test_pipeline_keeps_texts_when_no_language_is_known(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "abc", None), (2, "1 2", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_language_id_of_texts_of_any_length(spark):
    prose = lambda lang, n: " ".join("".join(R.choice(SYLLABLES[lang]) for _ in range(R.randrange(1, 4))) for _ in range(n))
    rows = [(i, prose(lang, 30), lang) for i, lang in enumerate(R.choice(list(SYLLABLES)) for _ in range(300))]
    rows += [(1000, rows[0][1], rows[0][2])] * 500  # one row many times does not crowd out the others
    truth = {2000 + n: lang for n, lang in enumerate([*SYLLABLES] * 3)}
    rows += [(i, prose(lang, (300, 3_000, 30_000)[(i - 2000) // 3]), None) for i, lang in truth.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, lang in truth.items())
    assert all(r.score == got[r.doc_id].score and r.lang_pred == got[r.doc_id].lang_pred for r in identify(df.repartition(7)).collect())


def test_language_id_learns_more_than_64_languages(spark):
    rows = []
    for n in range(70):
        own = [f"{chr(0x4E00 + 16 * n + k)}{chr(0x4E00 + 16 * n + (k + 1) % 16)}" for k in range(16)]
        rows += [(100 * n + k, " ".join(R.choice(own) for _ in range(30)), f"l{n:02}") for k in range(12)]
    langs, _ = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == sorted({r[2] for r in rows})
