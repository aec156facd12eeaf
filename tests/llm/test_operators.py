"""The operators on small tables with every awkward row, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ann, chat, hpylm, jaccard, media, mixing, packing, pii, quality, queries, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, part long, size string, n long, starts string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts() -> list[tuple]:
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "naïve", "THE", "the", "日本", "a b"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, long = prose(60), prose(6000)
    base = prose(200).split()
    out = [None, "", " \n\t ", "one", "one", "One", "a b c d", "a b c d", passage, "x " + passage + " y " + passage, long, long, "z" * 5000]
    for k in range(12):  # near copies of one text, in a chain
        own = list(base)
        own[k * 7 : k * 7 + 2] = [f"n{k}", f"m{k}"]
        out.append(" ".join(own))
    out += [prose(n) for n in (3, 5, 19, 20, 21, 400)]
    out += ["call +1 (988) 555-2485 or a.b+c@mail.example.com, 4041894974608795 at 1.2.3.4 and 256.1.1.1", "12 34", "+12", "@", "a@b", "a@b.c%x@d.e.f", "1.2.3.4.5.6.7.8", "0000-0000-0000-0000 1"]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "key", 0.1, 1, "size", 2, "s") for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in texts()}


def lowered(t: str) -> list[str]:
    return [w.encode().lower().decode() for w in WORD.findall(t)]


def by_id(df, key="doc_id"):
    rows = df.collect()
    got = {r[key]: r for r in rows}
    assert len(got) == len(rows)
    return got


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", "x</s>\\!<\\!"), (1, 2, "assistant", "x</s>\\!<\\!"), (1, 3, None, "<|more|>[INST]"), (2, 0, "we<|says|>ird", "<"), (None, None, "assistant", ""), (3, 5, "assistant", "<<SYS>><s>[/INST]<<|é日")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ts string")
    out = chat.format_chat(df)
    got = by_id(out.select("conv_id", "formatted", "loss_spans", chat.parse_chat(F.col("formatted")).alias("turns")), "conv_id")
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or -1, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert {c: [tuple(t) for t in g["turns"]] for c, g in got.items()} == want
    for c, g in got.items():
        spans = [g["formatted"][s["start"] : s["end"]] for s in g["loss_spans"]]
        assert len(spans) == sum(r == "assistant" for r, _ in want[c])
        inside = re.sub(r"<\|turn\|>|<\|says\|>|<\|more\|>|</s>", "", g["formatted"])
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", inside)
    assert got[1]["formatted"].count("<|turn|>") == 3
    assert chat.format_chat(df.limit(0)).count() == 0


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, 1 if i < 20 else 0, 0) for i in range(25)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    w = quality.fit(docs, labels)
    got = by_id(quality.score(docs.select("doc_id", "text"), w))
    assert len(got) == len(plain()) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[3]["score"] == got[4]["score"] and got[0]["score"] == got[1]["score"]
    assert quality.score(docs, w, "own").columns == [*docs.columns, "own"]
    none = quality.fit(empty, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}
    assert quality.score(empty.select("doc_id", "text"), w).count() == 0


def test_media(docs, empty):
    got = by_id(media.describe_media(media.media_column(docs)))
    for i, t in plain().items():
        p = media.payload(t.encode())
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[3]["media_sha256"] == got[4]["media_sha256"] and got[3]["feature"] == got[4]["feature"]
    assert media.describe_media(media.media_column(empty)).count() == 0


def test_mixing(docs, empty):
    got = by_id(mixing.mix_sources(docs))
    want = {i: len(WORD.findall(t)) for i, t in plain().items()}
    assert {i: r["size"] for i, r in got.items()} == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got.values())
    sources = defaultdict(list)
    for r in got.values():
        sources[r["source"]].append(r)
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in sources[s]) for s in order]
    for s, n, target in zip(order, sizes, mixing.targets(sizes)):
        assert {(r["source_size"], r["target"]) for r in sources[s]} == {(n, target)}
        assert abs(sum(r["taken"] for r in sources[s]) - target) <= 3 * mixing.BLOCK_WORDS
    again = by_id(mixing.mix_sources(docs.repartition(7)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix_sources(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert Counter(r["doc_id"] for r in whole.collect()) == {i: r["copies"] for i, r in got.items() if r["copies"]}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text: str) -> list[tuple]:
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.PLAIN[k], text) if ok(k, m[0])]


def test_pii_base(docs, empty, spark):
    rng = random.Random(9)
    odd = ["".join(rng.choices("aZ09.@+- ()%é日", k=rng.randint(0, 60))) for _ in range(1500)] + ["1" * 40_000, "1 " * 20_000, "a" * 40_000 + "@", "a@" + "b." * 10_000, "+1" + "(" * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, base string").repartition(4)
    for r in df.select("text", pii.base_spans(F.col("text")).alias("b")).collect():
        assert [tuple(s) for s in r["b"]] == base(r["text"]), r["text"][:80]
    got = by_id(pii.find_pii(docs))
    for i, t in plain().items():
        assert [tuple(s) for s in got[i]["base"]] == base(t)
    assert pii.find_pii(empty).count() == 0


def test_pii_contexts(spark):
    rows = [(i, f"please write to user{i}x@mail.example.com today") for i in range(6)]
    rows += [(10, "please write to 77-1234-AB today"), (11, "version 77-1234-AC is out"), (12, None), (13, "please write to us")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(pii.find_pii(df))
    assert [tuple(s) for s in got[10]["found"]] == [("context", 16, 26)]
    assert all(not r["found"] for i, r in got.items() if i != 10)
    clean = by_id(pii.redact(df))
    assert clean[0]["text"] == "please write to <email> today" and clean[10]["text"] == "please write to <context> today"
    assert clean[11]["text"] == rows[7][1] and clean[12]["text"] is None and clean[0]["n_chars"] == len(clean[0]["text"])


def test_pii_contexts_reach_records_unseen_identifiers_and_handles(spark):
    rows = [(i, f"phone +1 555 010 {1000 + i} account user{i}@mail.example.com") for i in range(5)]
    rows += [(10, "phone +1 555 010 9999 account 77123456"), (11, "phone +1 555 010 8888 account jane@host")]
    rows += [(20 + i, f"mail user{i}b@mail.example.com") for i in range(4)] + [(30 + i, f"mail 4455{i}") for i in range(9)]  # one word at a start; more unseen than seen
    rows += [(40, "invoice 991234 came"), (41, "4455 alone")]
    rows += [(50 + i, f"host at 1.2.3.{i}") for i in range(3)] + [(60 + i, f"host at 1.2.3.{900 + i}") for i in range(3)] + [(70, "host at 123456")]  # as many refused as seeds
    got = by_id(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))
    texts = dict(rows)
    found = {i: [texts[i][s["start"] : s["end"]] for s in r["found"]] for i, r in got.items()}
    assert {i: f for i, f in found.items() if f} == {10: ["77123456"], 11: ["jane@host"]} | {30 + i: [f"4455{i}"] for i in range(9)}


def test_pii_whole_entities_are_instances(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400-0000-0000-0000", "6011 0000 0000 0004", "4012 8888 8888 1881"]
    rows = [(i, f"Please pay with card {c}, today") for i, c in enumerate(cards)] + [(10 + i, f"write to address jane{i}@corp.example now") for i in range(4)]
    rows += [(20, "please pay with card 4999 8888 7777 today"), (21, "Write to address jane@corp, now"), (22, "please pay with card 12 today"), (23, "é日\n" * 3000 + "x write to address (joe@corp); a@b.co" + " é" * 5000)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {i: [texts[i][s["start"] : s["end"]] for s in r["found"]] for i, r in by_id(pii.find_pii(df)).items()}
    assert {i: f for i, f in found.items() if f} == {20: ["4999 8888 7777"], 21: ["jane@corp"], 23: ["joe@corp"]}
    clean = by_id(pii.redact(df.withColumn("text_key", F.lit("kept")).withColumn("spans", F.lit("too"))))
    assert clean[23]["text"] == texts[23].replace("joe@corp", "<context>").replace("a@b.co", "<email>") and (clean[23]["text_key"], clean[23]["spans"]) == ("kept", "too")


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(900, None, "x"), (1000, [0.0] * 16, "x"), (1001, [None] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1003, [1.0], "x"), (1004, [float("inf")] * 16, "x"), (None, x[0].tolist(), "x"), rows[100]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node string")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert sorted(got) == list(range(0, 700, 50))
    hit, d64 = 0, x.astype(float)
    for q, found in got.items():
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(700), d))[:10]
        hit += len(set(best.tolist()) & {r["vec_id"] for r in found})
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12) for r in found)
    assert [r["vec_id"] for r in got[50]] == list(range(51, 61))
    assert hit / (10 * len(got)) >= 0.9
    bad = spark.createDataFrame([(0, [float("nan")] * 16, "x"), (50, None, "x"), (50, [0.0] * 16, "x")], df.schema)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df.union(bad), F.col("vec_id") % 50 == 0).collect()} == {(q, r["rank"], r["vec_id"]) for q in got for r in got[q]}
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nodes_alone_in_their_cells_have_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 4)  # 256 cells for 700 vectors, most of them in two tight clusters
    rng = np.random.default_rng(5)
    x = np.r_[1e-3 * rng.normal(size=(340, 16)) + 5, 1e-3 * rng.normal(size=(340, 16)) - 5, 40 * rng.normal(size=(20, 16))].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    points = ann.nodes(df).withColumn("asked", F.lit(False))
    own = ann.space(points, 700, 16)
    for row in ann.start_graph(points, own).df.collect():
        nbr = own.opened(row.asDict())[2]
        assert ((nbr >= 0).sum(1) >= ann.K).all()
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") >= 680).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(680, 700)) and {len(v) for v in got.values()} == {10}
    hit = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += (np.sort(d[found]) <= np.sort(d)[:10] * (1 + 1e-4)).sum()
    assert hit >= 180


def test_lm(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = by_id(hpylm.score_documents(docs, held))
    tokens = {i: [*lowered(t), " "] for i, t in plain().items()}
    c = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 3 for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))
    assert got[6]["score"] == got[7]["score"]
    assert hpylm.score_documents(empty, held).count() == 0
    alone = hpylm.score_documents(docs.where("doc_id < 5"), F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


def test_lm_learns_the_order_of_words(spark):
    rng = random.Random(8)
    ring = [f"{c}same" for c in "abcdefghijklmnopqrst"]  # words of one ending: only the word itself tells what follows it
    rows = []
    for i in range(60):
        k = rng.randrange(20)
        rows.append((i, " ".join(ring[(k + j) % 20] for j in range(40))))
    rows += [(100, " ".join(ring[j % 20] for j in range(40))), (101, " ".join(ring[-j % 20] for j in range(40))), (102, ""), (103, None), (104, "never met " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(hpylm.score_documents(df, F.col("doc_id") >= 100))
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"])
    assert got[100]["score"] / 41 > -0.3 and got[101]["score"] / 41 < -1.5  # 20 words: -1.3 by chance
    assert got[102]["score"] == got[103]["score"] < 0 and got[104]["score"] < got[102]["score"]


def test_substring(docs, empty, spark):
    def want(rows):
        seen, out = {}, {}
        for i, t in sorted(rows):
            w = WORD.findall(t)
            gone = [False] * len(w)
            for k in range(len(w) - 19):
                if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                    gone[k : k + 20] = [True] * 20
            out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode())
        return out

    got = by_id(substring.remove_repeats(docs))
    assert {i: (r["n_words"], r["n_removed"], bytes(r["kept"])) for i, r in got.items()} == want(plain().items())
    own = spark.createDataFrame([(1, "a " * 50), (2, "b c " * 30), (2, "b c " * 30), (None, "a " * 30)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(own).collect())
    assert rows == [(0, 29), (1, 50), (2, 58), (2, 58)]
    assert substring.remove_repeats(empty).count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, got = Tokenizer.from_file(path), defaultdict(list)
    rows = packing.pack_documents(docs, path, shard_tokens=3000).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    for i, t in plain().items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 2], 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_tokenizer_cache_agrees_with_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, cache = Tokenizer.from_file(path), packing.WordIds(path)
    odd = ["a<|endoftext|>b <|ENDOFTEXT|> c", "it's I'M don't 3.14 ½ é é İ ΑΣ ß\x1c\x85z", "a\x00b \U0001f600 　  x", " ́abc", "", "plain words, with dots... and 12 digits!! naïve été ß œuvre привет", "e\u0301te x\u0301 É é É"]
    for t, ids in zip(odd, cache.ids([o.encode() for o in odd])):
        assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def classes(rows):
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(docs, empty, spark):
    got = by_id(jaccard.ngram_classes(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == classes(plain().items())
    rng = random.Random(6)
    words = [f"v{k}" for k in range(80)]
    passage, rows = " ".join(rng.choices(words, k=30)), []
    for k in range(60):  # many texts that share a passage, and chains of near copies of several sizes
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(5, 60))) + " " + passage))
    for g in range(6):
        own = rng.choices(words, k=rng.choice((6, 9, 14, 40, 90)))
        for k in range(20):
            own = list(own)
            own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 20 * g + k, " ".join(own)))
    got = by_id(jaccard.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == classes(rows)
    assert jaccard.ngram_classes(empty).count() == 0


def test_families_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 9)
    rng = random.Random(16)
    words, rows = [f"v{k}" for k in range(90)], []
    for g in range(2):
        base = rng.choices(words, k=60)
        for k in range(70):
            own = list(base)
            for _ in range(rng.choice((1, 1, 2, 3, 4))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 * g + k, " ".join(own)))
    got = by_id(jaccard.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = classes(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert 2 < len({c for _, c in want.values()}) < len(rows)


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["utf8", "_utf8", "_id", "_key", "_copies", "_all", "_copy", "row_key", "group_key", "turn", "copies", "spans", "span_of", "quality_score", "_quality_score", "a.b", "bucket"]
    text = " ".join(f"w{i}" for i in range(30)) + " a@b.co"
    rows = [(i, t, "en", "s", 1, *names) for i, t in ((1, text), (1, text), (1, text), (2, text), (3, "other words that are here"), (3, "not the same text at all"), (4, None), (5, ""))]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        assert all(r[len(r) - len(names) :] == tuple(names) for r in out.collect()), name
    kept = [r["doc_id"] for r in corpus_pipeline.distinct(spark, now, "").collect()]
    assert sorted(kept) == [1, 3, 3, 4, 5]


def test_pipeline_stages(docs, empty, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, empty):
        now = rows.select("doc_id", "text", "lang", "source", "n_chars", "score")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= 0
    kept = {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, "").collect()}
    assert kept == {c if n else i for i, (n, c) in classes(plain().items()).items()}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def bootstrapped(rows, least=pii.LEAST):
    """doc_id -> values found by contexts, in plain Python; every instance here is one word, all texts are small."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen = []
    for i, t in rows:
        words = [m[0] for m in word.finditer(t)]
        special = [bool(re.search("[0-9@]", w)) for w in words]
        for k, w in enumerate(words):
            if special[k]:
                before = ["#" if special[j] else words[j] for j in range(max(0, k - 2), k)]
                seen.append((i, " ".join(before).lower(), w.strip(".,;:!?()")))
    edges = {(p, v) for _, p, v in seen if p and v}
    known = {v: 1.0 if base(v) == [(kind, 0, len(v)) for kind, _, _ in base(v)] and base(v) else None for _, v in edges}
    sure, score = {}, dict(known)
    while True:
        new = {}
        for p in {p for p, _ in edges} - set(sure):
            own = [score[v] for q, v in edges if q == p and score[v] is not None]
            if sum(own) >= pii.SUPPORT and sum(own) / len(own) >= pii.SURE:
                new[p] = sum(own) / len(own)
        if not new:
            break
        sure |= new
        for v in known:
            if known[v] is None and (c := [sure[p] for p, w in edges if w == v and p in sure]):
                score[v] = 1 - math.prod(1 - min(x, 0.999) for x in c)
    out = defaultdict(list)
    for i, p, v in seen:
        if p in sure and known[v] is None and (score[v] or 0) >= pii.SURE and ("@" in v or sum(c.isalnum() for c in v) >= least):
            out[i].append(v)
    return dict(out)


def test_pii_chains_of_contexts_are_followed_to_their_end(spark):
    rows = [(k, f"mail one{k}@mail.example.com now") for k in range(4)] + [(k, f"mail AB-{120 + k} now") for k in range(4, 8)]
    for level in range(6):  # each context's instances are those that the one before found
        rows += [(100 * level + 10 + k, f"level{'x' * level} context{'y' * level} ID-{level}{k}{k} end") for k in range(4)]
        rows += [(100 * level + 50 + k, f"next{'x' * level} after{'y' * level} ID-{level}{k}{k} end") for k in range(4)]
        rows += [(100 * level + 70 + k, f"next{'x' * level} after{'y' * level} ID-{level + 1}{k}{k} end") for k in range(4)]
    rows += [(700 + k, f"level context user{k}@mail.example.com end") for k in range(4)]
    rows += [(800 + 10 * level + k, f"level{'x' * (level + 1)} context{'y' * (level + 1)} ID-{level + 1}{k}{k}") for level in range(6) for k in range(4)]
    rows += [(900, "mail 12 now"), (901, "nowhere ID-333 end")]
    texts = dict(rows)
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["found"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() if r["found"]}
    assert got == bootstrapped(rows)
    assert got[4] == ["AB-124"] and got[873 - 20] == ["ID-633"] and 900 not in got
    all_of = pii.find_pii(spark.createDataFrame([r for r in rows if "mail" in r[1]], "doc_id long, text string"), least=1).where("doc_id = 900").first()
    assert len(all_of["found"]) == 1


def test_jaccard_of_many_rows_of_one_id(spark):
    """A row for each text goes on to be compared, whatever ids repeat."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(60)]
    own = rng.choices(words, k=200)
    texts = [" ".join([*own[:k], f"n{k}", *own[k + 1 :]]) for k in range(30)]
    for ids in ([None] * 30, [7] * 30, list(range(30))):
        df = spark.createDataFrame(list(zip(ids, texts)) + [(ids[0], texts[0])] * 40, "doc_id long, text string").repartition(3)
        got = jaccard.ngram_classes(df).collect()
        assert len(got) == 70 and {r["n_shingles"] for r in got} == {196}
        assert {r["component_id"] for r in got} == {ids[0]}


@pytest.mark.parametrize("sets", [4, 1024])
def test_families_of_large_and_small_components(spark, monkeypatch, sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    rng = random.Random(12)
    words = [f"v{k}" for k in range(200)]
    shared, rows = rng.choices(words, k=45), []
    for g in range(5):  # groups of copies that share a passage, but too little to link
        own = shared + rng.choices(words, k=30)
        for k in range(rng.choice((3, 25))):
            new = list(own)
            new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((1000 * g + k, " ".join(new)))
    got = by_id(jaccard.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == classes(rows)


def test_rows_of_a_family_grow_with_its_sets(spark):
    """Links connect a family before blocks are dealt, so that copies send no row there."""
    for n in (40, 80):
        own = spark.range(n).select(F.lit(1).cast("long").alias("root"), F.lit(1).cast("long").alias("comp"), F.col("id").alias("node"), F.lit(9).alias("n"), F.lit(b"").alias("z"))
        assert jaccard.dealt(own).count() == 0
        assert jaccard.dealt(own.withColumn("comp", F.col("node") % 2)).count() == n
