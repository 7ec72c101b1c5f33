"""Chat, media, classifiers, URL globs, sharding and mixing on small and odd inputs."""

from __future__ import annotations

import collections
import fnmatch
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixtures import brute_targets

from leakloom.llm import chat, mixing, quality, queries, sharding, textcore, tiff, toxicity, urlglob

DOCS = "doc_id bigint, text string, source string"
ODD = ["", " \n\t ", "a", "é" * 9, "x" * 70_000, "tab\tand\x0bvt\x0cff\rcr", "NUL\0in", "word " * 5000, "\u00a0nbsp\u2003em"]


def docs(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# text primitives


def test_words_and_hashes_agree_with_python():
    import re

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\n\t.") for _ in range(rng.randrange(60))) for _ in range(200)]
    buf, rows = textcore.flat(pa.array([*texts, None]))
    start, end, first = textcore.words(buf, rows)
    h = textcore.word_hashes(buf, start, end)
    seen: dict[bytes, int] = {}
    for i, t in enumerate([*texts, ""]):
        own = [bytes(buf[a:b]) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)]
        assert own == re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
        for w, x in zip(own, h[first[i] : first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 12, 35])
def test_grams_depend_on_order_and_place_only(k):
    h = np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64)
    g = textcore.grams(np.concatenate([h, h, h[::-1]]), k)
    assert len(g) == 300 - k + 1 and (g[: 100 - k + 1] == g[100 : 200 - k + 1]).all()
    assert k == 1 or len(np.unique(g[:200 - k + 1])) == 100
    assert len(textcore.grams(h[: k - 1], k)) == 0


# chat

CHAT = "conv_id bigint, turn bigint, role string, text string, ids string, loss int"


def test_chat_round_trip_of_odd_turns(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROL, chat.MARK, chat.MARK * 2, "<", "</s", "[INST", "é", "\n", " ", "日本"]
    rows = [(1, 0, "user", "hi", "x", 0), (1, 1, "assistant", None, None, None), (2, None, None, "no turn", None, 1), (2, 0, "assistant", "x" * 200_000, None, 1), (None, 0, "assistant", "null id", None, 1), (3, 0, "user", "same", "", 1), (3, 0, "user", "same", "", 1), (3, 0, "assistant", "tie", "", 1)]
    rows += [(10 + i % 7, i, rng.choice(["user", "assistant", "</s>", "system"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12))), None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, CHAT)
    formatted = chat.format_chat(df)
    got = {r["conv_id"]: r for r in chat.read_chat(formatted).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    shuffled = {r["conv_id"]: r for r in chat.read_chat(formatted.orderBy(F.rand(1)).repartition(3)).collect()}
    assert shuffled == got
    starts = {(r["conv_id"], r["position"]): (r["start"], len(r["ids"]), sum(r["loss"])) for r in formatted.collect()}
    assert all(s == sum(starts[c, q][1] for q in range(p)) for (c, p), (s, _, _) in starts.items())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_one_conversation_over_many_tasks(spark, parts):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"turn {rng.random()}", "x", 0) for i in range(60)] + [(2, 5, "user", "same", "x", 0)] * 300 + [(c, t, "assistant", f"{c} {t}", "x", 0) for c in (None, 0, 3, 4) for t in range(c or 1)]
    df = spark.createDataFrame(rows, CHAT).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        formatted = chat.format_chat(df)
        got = collections.defaultdict(dict)
        used = collections.defaultdict(set)
        for r in formatted.withColumn("_p", F.spark_partition_id()).collect():
            got[r["conv_id"]][r["position"]] = r
            used[r["conv_id"]].add(r["_p"])
        sums = {r["conv_id"]: r for r in chat.read_chat(formatted).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert parts < 40 or (len(used[1]) > 1 and len(used[2]) > 3)
    first = formatted.first()["ids"][0]
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2], r[3]) for r in rows if r[0] == c)
        assert sorted(got[c]) == list(range(len(turns)))
        done = 0
        for i in range(len(turns)):
            r = got[c][i]
            assert r["start"] == done and (first in r["ids"]) == (i == 0) and (first + 1 in r["ids"]) == (i == len(turns) - 1)
            done += len(r["ids"])
        assert sums[c]["n_turns"] == len(turns) and sums[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()


@pytest.mark.parametrize("text", ["word " * 40_000, "x" * 200_000, "é1 \n!" * 40_000, " " * 200_000])
def test_long_texts_have_the_ids_of_the_whole(spark, text):
    with open(chat.VOCABULARY, "rb") as f:
        codec = chat.Codec(f.read())
    row = chat.format_chat(spark.createDataFrame([(1, 0, "assistant", text, "x", 0)], CHAT)).first()
    ids = codec.enc.encode_ordinary(text)
    assert [i for i, m in zip(row["ids"], row["loss"], strict=True) if m] == ids and codec.decode(ids) == text


def test_chat_of_nothing(spark):
    assert chat.read_chat(chat.format_chat(spark.createDataFrame([], CHAT))).count() == 0


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "␛", "<␛/s>", "␛␛</s>␛", "<<s>>", "[INST][INST]"])
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


# media


def image(h, w, seed=0):
    rng = np.random.default_rng(seed)
    return rng.choice(np.array([0, 0, 0, 7, 200], np.uint8), (h, w))


@pytest.mark.parametrize("store", tiff.STORES)
def test_tiff_round_trip(store):
    pages = [image(70, 64), image(1, 64, 1), image(300, 64, 2)]
    got = list(tiff.read_tiff(tiff.write_tiff(pages, **store)))
    assert [p.page for p in got] == [0, 1, 2]
    assert all(p.pixels == x.tobytes() and (p.height, p.width) == x.shape for p, x in zip(got, pages, strict=True))


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 9, b"\0" * 1000, bytes(range(256)) * 300, random.Random(5).randbytes(60_000), b"abcabcabd" * 4000])
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def written(order, entries, data, big=False):
    """A one-page file of the given fields: (tag, type, values)."""
    size = {3: 2, 4: 4}
    letter = {3: "H", 4: "I"}
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16 + len(data)) if big else (42, 8 + len(data))))) + data
    at = len(out)
    rows, extra = [], b""
    base = at + (8 if big else 2) + len(entries) * (20 if big else 12) + (8 if big else 4)
    for tag, kind, vals in sorted(entries):
        packed = struct.pack(f"{order}{len(vals)}{letter[kind]}", *vals)
        room = 8 if big else 4
        if len(packed) > room:
            where, extra = base + len(extra), extra + packed
            packed = struct.pack(order + ("Q" if big else "I"), where)
        rows.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(vals)) + packed.ljust(room, b"\0"))
        assert size[kind]
    return bytes(out) + struct.pack(order + ("Q" if big else "H"), len(rows)) + b"".join(rows) + bytes(8 if big else 4) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_rgb_16_bit_with_predictor_planes_and_bits(order, big):
    at = 16 if big else 8
    rgb = np.random.default_rng(1).integers(0, 65536, (3, 5, 3)).astype(np.uint16)
    diff = np.diff(rgb, axis=1, prepend=np.uint16(0)).astype(order + "u2")
    data = zlib.compress(diff.tobytes())
    common = [(256, 4, [5]), (257, 4, [3]), (258, 3, [16, 16, 16]), (277, 3, [3])]
    page = next(tiff.read_tiff(written(order, [*common, (259, 3, [8]), (317, 3, [2]), (273, 4, [at]), (278, 4, [3]), (279, 4, [len(data)])], data, big)))
    assert page.pixels == rgb.astype("<u2").tobytes()
    planes = b"".join(rgb[..., i].astype(order + "u2").tobytes() for i in range(3))
    page = next(tiff.read_tiff(written(order, [*common, (259, 3, [1]), (284, 3, [2]), (273, 4, [at, at + 30, at + 60]), (279, 4, [30, 30, 30])], planes, big)))
    assert page.pixels == rgb.astype("<u2").tobytes()
    ones = np.random.default_rng(2).integers(0, 2, (4, 11)).astype(np.uint8)
    raw = np.packbits(ones, axis=1).tobytes()
    page = next(tiff.read_tiff(written(order, [(256, 4, [11]), (257, 4, [4]), (273, 4, [at]), (279, 4, [len(raw)])], raw, big)))
    assert page.pixels == ones.tobytes()


def test_tiff_float_predictor():
    x = np.random.default_rng(3).normal(size=(2, 6)).astype(np.float32)
    planes = x.astype(">f4").view(np.uint8).reshape(2, 6, 4).transpose(0, 2, 1).reshape(2, 24)
    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    page = next(tiff.read_tiff(written("<", [(256, 4, [6]), (257, 4, [2]), (258, 3, [32]), (339, 3, [3]), (317, 3, [3]), (273, 4, [8]), (279, 4, [len(raw)])], raw)))
    assert np.frombuffer(page.pixels, np.float32).tolist() == x.ravel().tolist()


def test_damaged_files_give_errors_after_good_pages(spark):
    good = tiff.write_tiff([image(3, 16), image(4, 16)])
    loop = bytearray(tiff.write_tiff([image(3, 16)]))
    loop[-4:] = loop[4:8]
    rows = [(1, good, "x"), (2, bytes(loop), "x"), (3, good[:60], "x"), (4, None, "x"), (5, b"", "x"), (6, b"GIF89a..", "x"), (7, good, "x")]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, x) for i, m, x in rows], "id int, media binary, page string").drop("page")
    got = collections.defaultdict(list)
    for r in tiff.tiff_pages(df, keep=["id"]).collect():
        got[r["id"]].append((r["page"], r["error"] is not None))
    assert got[1] == got[7] == [(0, False), (1, False)]
    assert got[2] == [(0, False), (None, True)]
    assert all(got[i] == [(None, True)] for i in (3, 4, 5, 6))
    assert tiff.tiff_pages(df.where("id < 0")).count() == 0
    assert [r["error"] is not None for r in tiff.tiff_pages(df.where("id = 1"), most_bytes=10).collect()] == [True]


def packed_fields(fields, data=b"\0" * 64, order="<"):
    """A one-page file of raw fields: (tag, type, count, value bytes of four)."""
    rows = b"".join(struct.pack(order + "HHI", t, k, n) + v.ljust(4, b"\0") for t, k, n, v in fields)
    return struct.pack(order + "2sHI", b"II", 42, 8 + len(data)) + data + struct.pack(order + "H", len(fields)) + rows + bytes(4)


def field(tag, value, kind=4):
    return tag, kind, 1, struct.pack("<I", value)


PAGE_FIELDS = {256: field(256, 8), 257: field(257, 8), 258: field(258, 8), 273: field(273, 8), 279: field(279, 64)}


@pytest.mark.parametrize(
    "changed",
    [
        {256: (256, 4, 0, b"")}, {256: (256, 11, 1, struct.pack("<f", 8.0))}, {256: (256, 2, 1, b"8")}, {257: (257, 9, 1, struct.pack("<i", -8))}, {277: (277, 8, 1, struct.pack("<h", -1))},
        {273: (273, 11, 1, struct.pack("<f", 8.0))}, {273: (273, 9, 1, struct.pack("<i", -8))}, {279: (279, 5, 1, b"\10")}, {258: (258, 2, 1, b"\10")}, {317: field(317, 7)}, {317: field(317, 3)},
        {256: field(256, 1 << 20), 257: field(257, 1), 322: field(322, 16), 323: field(323, 1 << 24), 324: field(324, 8), 325: field(325, 64)}, {259: field(259, 99)}, {256: field(256, 0)}, {278: field(278, 3)}, {273: field(273, 1 << 31)},
        {258: field(258, 1), 317: field(317, 2)}, {256: (256, 4, 1 << 30, b"\0\0\0\0")}, {262: field(262, 0xFFFFFFFF)}, {284: field(284, 2), 277: field(277, 3)},
    ],
)
def test_malformed_tags_are_errors(changed):
    assert next(tiff.read_tiff(packed_fields(PAGE_FIELDS.values()))).pixels == bytes(64)
    with pytest.raises(tiff.TiffError):
        list(tiff.read_tiff(packed_fields([v for _, v in sorted((PAGE_FIELDS | changed).items())]), 1 << 16))


def test_any_bytes_give_pages_or_an_error():
    rng = random.Random(11)
    files = [tiff.write_tiff([image(9, 16), image(40, 16)], **s) for s in tiff.STORES] + [packed_fields(PAGE_FIELDS.values())]
    for i in range(4000):
        data = bytearray(rng.choice(files))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data)) if rng.random() < 0.5 else max(0, len(data) - rng.randrange(1, 200))
            data[at] = rng.choice([0, 1, 2, 5, 11, 127, 128, 255, rng.randrange(256)])
        try:
            for p in tiff.read_tiff(bytes(data[: rng.choice([len(data), rng.randrange(len(data) + 1)])]), 1 << 16):
                assert len(p.pixels) == p.width * p.height * p.samples * max(1, p.bits // 8) <= 1 << 16
        except tiff.TiffError:
            pass


def test_payload_query_reads_back_every_text(spark, tmp_path):
    df = docs(spark, [*ODD, None, ODD[3]])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op2_tiff_pages(spark, str(tmp_path)).collect()}
    for i, t in enumerate([*ODD, None, ODD[3]]):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), None)
    assert got[3]["feature"] == got[len(ODD) + 1]["feature"] and got[3]["media_sha256"] == got[len(ODD) + 1]["media_sha256"]


# classifiers


def prose(rng, n, junk=False, toxic=False):
    words = ["".join(rng.choice(["an", "er", "th", "on", "in"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    if junk:
        words = [w + rng.choice(["%%%", "$$$"]) for w in words]
    if toxic:
        for _ in range(3):
            words[rng.randrange(n)] = rng.choice(["vileword", "badthing"])
    return " ".join(words)


def labelled_rows(kind):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, prose(rng, rng.randrange(8, 60), **{kind: bad}), "s"))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad), int(bad)))
    return rows, labels


def test_network_gradient_is_right():
    rng = np.random.default_rng(0)
    net = quality.ByteNet(quality.Shape(4, 2, 3, 8, 4), 1)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (1, 40, 90)]
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf, y, w = np.frombuffer(b"".join(texts), np.uint8), np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net._gradient(buf, rows, y, w)

    def loss():
        p = net.forward(buf, rows)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k in ("out", "mid", "mid_b"):
        for i in range(min(4, net.p[k].size)):
            flat = net.p[k].reshape(-1)
            flat[i] += 1e-4
            up = loss()
            flat[i] -= 2e-4
            down = loss()
            flat[i] += 1e-4
            assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 2e-3


def test_quality_on_held_out_rows_and_odd_texts(spark):
    rows, labels = labelled_rows("junk")
    lab = spark.createDataFrame([*labels, (999, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame([*rows, (1000, None, "s"), (1001, "", "s"), (1002, "an er " * 200_000, "s"), (None, "an er", "s")], DOCS)
    net = quality.fit_quality(df, lab)
    got = quality.score_texts(df.withColumn("score", F.lit("old")), net).withColumn("h", quality.bucket("doc_id", 4) == 2).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [(r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in got if r["h"] and r["doc_id"] in truth]
    assert sum(held) / len(held) > 0.95
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1000] == by[1001] and by[1002] > 0.5
    assert quality.score_texts(df.limit(0), net).count() == 0
    none = quality.fit_quality(df, lab.limit(0))
    assert {r["score"] for r in quality.score_texts(df, none).collect()} == {0.5}


def test_the_sample_is_bounded_by_rows(spark):
    rows = [(1, "a b")] + [(2, f"text {i}") for i in range(3000)] + [(3, "c d"), (4, None), (5, "x" * 99), (6, "e f"), (7, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (3, 0), (4, 1), (5, 1), (6, None), (7, 0), (7, None), (None, 1)], "doc_id bigint, quality int")
    texts, y = quality.labelled(df, labels, "quality", {0: 10, 1: 10}, 50, 4, 9)
    assert len(texts) == len(y) == 3 and sorted(y.tolist()) == [0, 0, 1] and {b"a b", b"g"} < set(texts)
    assert sorted(quality.labelled(df.repartition(3), labels, "quality", {0: 10, 1: 10}, 50, 4, 9)[0]) == sorted(texts)
    assert len(quality.labelled(df, labels, "quality", {0: 1, 1: 1}, 50, 4, 9)[0]) == 2


def plain_score(net, text):
    """The network's probability, filter by filter and window by window."""
    s, p = net.shape, {k: v.astype(np.float64) for k, v in net.p.items()}
    span = s.half * s.stride
    halves = -(-(len(text) + s.width - s.stride) // span)
    symbols = list(text) + [quality.PAD] * (halves * span + s.width - len(text))
    best = np.full((halves, s.filters), -np.inf)
    for h in range(halves):
        for w in range(s.half):
            at = (h * s.half + w) * s.stride
            if h == halves - 1 and w >= s.half - -(-(s.width - s.stride) // s.stride):
                continue
            best[h] = np.maximum(best[h], sum(p["table"][k][symbols[at + k]] for k in range(s.width)))
    hidden = []
    for a, b in [(i, i + 1) for i in range(halves - 1)] or [(0, 0)]:
        fill = [min(max(len(text) - h * span, 0), span) / span for h in (a, b)]
        x = np.append(np.maximum(np.maximum(best[a], best[b]), 0), (fill[0] + (fill[1] if a != b else 0)) / 2)
        hidden.append(np.maximum(x @ p["mid"] + p["mid_b"], 0))
    return 1 / (1 + np.exp(-(np.max(hidden, 0) @ p["out"] + p["out_b"][0])))


def test_scores_equal_a_plain_forward_pass(spark, data):
    """The query's own network and scores, window by window, on whole texts."""
    rows = {r["doc_id"]: r for r in queries.op4_byte_cnn(spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    net = quality.fit_quality(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels")))
    few = sorted(rows, key=lambda i: len(texts[i] or ""))
    for i in few[:12] + few[len(few) // 2 : len(few) // 2 + 3]:
        r = rows[i]
        assert abs(r["score"] - plain_score(net, (texts[i] or "").encode())) < 1e-4
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_scores_equal_brute_force(spark, data):
    """The query's scores from marginals word by word, over the whole of every text."""
    rows = {r["doc_id"]: r for r in queries.op9_crf_spans(spark, data).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    chain = toxicity.fit_toxicity(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels")))
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    names = dict(zip(chain.table.keys.tolist(), chain.table.values.tolist(), strict=True))
    for i, text in texts.items():
        raw = (text or "").encode()
        found = [m.group().translate(low) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
        e = []
        for w in found:
            total = chain.bias
            for n in (0, *toxicity.PREFIXES):
                part = w[:n] if n else w
                if n and len(w) <= n:
                    continue
                h = textcore.word_hashes(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))
                key = int(h[0]) if not n else int(textcore.mix(h + np.uint64(toxicity.PREFIXES.index(n) + 1))[0])
                total += names.get(key, 0.0)
            e.append(total)
        m, p = np.exp(chain.trans - chain.trans.max()), []
        ahead, back = [np.array([1.0, 0.0])], [np.ones(2)]
        steps = [m * np.exp([0.0, x] - np.maximum(0, x)) for x in e]
        for t in steps:
            v = ahead[-1] @ t
            ahead.append(v / v.sum())
        for t in reversed(steps):
            v = t @ back[-1]
            back.append(v / v.sum())
        back.reverse()
        p = [a[1] * b[1] / (a @ b) for a, b in zip(ahead[1:], back[1:], strict=True)]
        x = np.log1p(sum(q for q in p if q >= toxicity.SURE)), max(p, default=0.0)
        a, b, c = chain.curve
        assert abs(rows[i]["score"] - 1 / (1 + np.exp(-(a + b * x[0] + c * x[1])))) < 1e-6, i
        assert rows[i]["predicted"] == int(rows[i]["score"] >= 0.7) and rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def brute_marginals(e, trans):
    """Sums over all state sequences."""
    import itertools

    n = len(e)
    p = np.zeros(n)
    total = 0.0
    for seq in itertools.product((0, 1), repeat=n):
        w, last = 0.0, 0
        for s, x in zip(seq, e, strict=True):
            w += trans[last, s] + x * s
            last = s
        total += np.exp(w)
        p += np.exp(w) * np.array(seq)
    return p / total


def test_marginals_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    trans = rng.normal(size=(2, 2))
    lengths = [0, 1, 5, 0, 9, 12, 3]
    e = rng.normal(0, 2, sum(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)])
    for block in (1, 4, 128):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        p, moves = toxicity.marginals(e, first, trans, pairs=True)
        want = np.concatenate([brute_marginals(e[a:b], trans) for a, b in zip(first[:-1], first[1:], strict=True)])
        assert np.allclose(p, want) and np.isclose(moves.sum(), len(e)) and np.isclose(moves[:, 1].sum(), want.sum())
    p, _ = toxicity.marginals(np.concatenate([np.full(500, 800.0), np.full(500, -800.0)]), np.array([0, 1000]), trans)
    assert np.isfinite(p).all()


def test_toxicity_finds_words_scores_and_offsets(spark):
    rows, labels = labelled_rows("toxic")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    odd = [(1000, None, "s"), (1001, "", "s"), (1002, "éé Vileword, éé badthing's", "s"), (1003, "an er " * 100_000 + "vileword vileword vileword", "s"), (None, "an er", "s")]
    df = spark.createDataFrame([*rows, *odd], DOCS)
    chain = toxicity.fit_toxicity(df, lab)
    got = toxicity.tag_texts(df.withColumn("spans", F.lit(1)), chain).withColumn("h", quality.bucket("doc_id", 3) == 1).collect()
    truth = {i: t for i, _, t in labels}
    assert all((r["score"] >= 0.7) == (truth[r["doc_id"]] == 1) for r in got if r["h"] and r["doc_id"] in truth)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] < 0.7 and by[1003]["score"] > 0.7
    text = odd[2][1]
    assert [text[s["start"] : s["end"]] for s in by[1002]["spans"]] == ["Vileword", "badthing"]
    assert toxicity.tag_texts(df.limit(0), chain).count() == 0
    blank = toxicity.fit_toxicity(df, lab.limit(0))
    assert len({r["score"] for r in toxicity.tag_texts(df, blank).collect()}) == 1


# URL globs


def test_globs_equal_fnmatch():
    rng = random.Random(9)
    globs = ["*", "", "a*b", "??", "*ab*ab*", "a" * 70 + "*", "*" + "b" * 130, "?*c", "abc"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["", "a" * 75, "c" + "b" * 131] + ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(300)]
    auto = urlglob.Automaton(globs)
    got = auto.run(*textcore.flat(pa.array(texts)))
    want = np.array([[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts])
    assert (got == want).all() and auto.words > 3


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Org", "http://a.org/", "https://x.EXAMPLE.org/en/1?q", "https://example.org/en/2#f", "http://notexample.org/en/1", "http://e.com/x.example.org/en/1", "s://de.com/de/", "http://casino.net/", "http://casino.net", "a://b://c.org/x", "http://w/\0/x", "http://org/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[5]])], "page_id int, url string, more string")
    got = {r["page_id"]: r for r in urlglob.judge_urls(df, queries.URL_RULES, queries.URL_BLOCKED).collect()}

    def expect(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.label), default=None)
        return host, path, best and best.label, best.verdict if best else "block" if "casino" in host and path.startswith("/") else "allow"

    for i, u in enumerate(urls):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expect(u), u
    assert urlglob.judge_urls(df.limit(0), queries.URL_RULES, []).count() == 0


# sharding and mixing


def check_shards(rows, shards, slack):
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(load.values())
    assert all(0 <= s < shards for s in load) and max(load.values()) - min(load[s] for s in range(shards)) <= slack * total / shards


def test_shards_of_mixed_sizes_hot_groups_and_repeated_rows(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(int(10 ** rng.uniform(0, 3)))) for _ in range(1500)] + ["hot text " * 8] * 900 + [None, "", ""]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id < 3")).union(spark.createDataFrame([(None, "null id", None)] * 2, DOCS)).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_table(df, 8).collect()
    assert len(rows) == len(texts) + 5
    check_shards(rows, 8, 0.05)
    again = sharding.shard_table(df.repartition(3), 8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["shard"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["shard"]) for r in again)
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["text_crc32"] == zlib.crc32(texts[5].encode()) and by[2400]["size"] == 8
    held = sharding.shard(df, 8).collect()
    assert sum(r["shard"] == by[r["doc_id"]]["shard"] for r in held if r["doc_id"] is not None) >= len(texts) - 3


@pytest.mark.parametrize("texts", [[], ["one"], [None, None], ["x" * 100_000, "y"], ["same"] * 50])
def test_shards_of_little(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    rows = sharding.shard_table(df, 4).collect()
    assert len(rows) == len(texts)
    check_shards(rows, 4, 1e9) if rows else None
    assert sharding.shard(df, 4).count() == len(texts)


@pytest.mark.parametrize("ids", [[5] * 6000, [None] * 6000])
def test_half_of_all_rows_equal_each_other(spark, ids):
    rng = random.Random(1)
    rows = [(i, "the same text", "s") for i in ids] + [(10 + i, "x" * rng.randrange(1, 40), "s") for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = sharding.shard_table(df, 24).collect()
    assert len(got) == 12_000
    check_shards(got, 24, 0.05)
    held = sharding.shard(df, 24).groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("size")).collect()
    sizes = [r["size"] for r in held]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.1 * sum(sizes) / 24
    again = sharding.shard(spark.createDataFrame(rows, DOCS).coalesce(1), 24).groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("size")).collect()
    table = collections.Counter()
    for r in got:
        table[r["shard"]] += r["size"]
    assert {r["shard"]: r["size"] for r in again} == table  # in one task the turns are exact


def test_ranges_are_divided_without_splitters(spark):
    rows = sharding.counted(sharding.keyed(docs(spark, [f"text {i}" for i in range(300)])))
    plan = sharding.plan_shards(rows, 3, fine=4, oversample=0)  # no sample at all: ranges are halved
    n = np.bincount(np.searchsorted(plan.bounds, np.array([r["key"] for r in rows.collect()]), "right"))
    assert n.sum() == 300 and n.max() <= 2 * 300 / 12 + 1


def test_shards_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", "same", "z" * rng.randrange(1, 300)]) for _ in range(400)]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id < 40"))
    want = collections.Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in [*enumerate(texts), *list(enumerate(texts))[:40]])
    rows = sharding.shard_table(df, 5).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check_shards(rows, 5, 0.2)
    # the same plan by hand: rows in order of their keys fill the ranges, ranges fill shards in order
    keys = sharding.keyed(df).collect()
    plan = sharding.plan_shards(sharding.counted(sharding.keyed(df)), 5)
    small = sorted((r["key"], r["doc_id"], r["size"], r["text_crc32"]) for r in keys)
    small = [r for r in small if r not in plan.dealt]
    slots = collections.Counter()
    place = collections.defaultdict(list)
    for record, portions in plan.dealt.items():
        for s, slot, n in portions:
            place[record[1:]] += [(s, slot + i) for i in range(n)]
            slots[s] = max(slots[s], slot + n)
    for r in small:
        s = int(plan.shard_of[np.searchsorted(plan.bounds, r[0], "right")])
        place[r[1:]].append((s, slots[s]))
        slots[s] += 1
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["size"], r["text_crc32"]].append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in place.items()}


def test_sharding_and_mixing_queries(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    got = queries.op6_sampled_shards(spark, data).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest = max(r["size"] for r in got)
    assert max(load.values()) <= max(biggest, sum(load.values()) / 24 * 1.05) and min(load.values()) > 0
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    sources = collections.Counter()
    for r in rows:
        sources[r["source"]] += count(r["text"] or "")
    goal = brute_targets(list(sources.items()))
    mixed, taken = queries.op10_hash_mix(spark, data).collect(), collections.Counter()
    assert len(mixed) == len(rows)
    for r in mixed:
        n = count(texts[r["doc_id"]])
        assert r["size"] == n and r["source_size"] == sources[r["source"]] and r["target"] == goal[r["source"]] and r["taken"] in (0, n, 2 * n, 3 * n)
        taken[r["source"]] += r["taken"]
    small = {s: min(count(r["text"] or "") for r in rows if r["source"] == s) for s in sources}
    assert all(abs(taken[s] - goal[s]) <= max(0.01 * goal[s], 60, small[s]) for s in sources)


def targets_of(spark, sizes, *args):
    rows = spark.createDataFrame(sizes, "source string, size bigint")
    return {r["source"]: r["target"] for r in mixing.targets(rows.repartition(3), *args).collect()}


def test_targets_share_the_excess(spark):
    t = targets_of(spark, [("b", 1000), ("a", 10), (None, 100), ("c", 0)], (5, 2, 1), 3)
    assert t["a"] == 30 and t[None] <= 300 and t["c"] == 0 and abs(sum(t.values()) - 1110) < 1e-6
    assert targets_of(spark, []) == {} and targets_of(spark, [("a", 7)]) == {"a": 7}
    assert targets_of(spark, [("a", 0), ("b", 0)]) == {"a": 0, "b": 0}
    rng = random.Random(8)
    for n in (4, 60, 300):
        sizes = [(f"s{i:03}é"[: rng.randrange(3, 6)] + str(i), int(10 ** rng.uniform(0, 6))) for i in range(n)] + [(None, 50), ("", 9)]
        assert targets_of(spark, sizes) == brute_targets(sizes)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 30), f"s{rng.randrange(40)}" if i % 3 else "hot") for i in range(2500)]
    df = spark.createDataFrame(rows, DOCS)
    got, taken = mixing.mix_table(df).collect(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    goal = brute_targets(list(size.items()))
    assert len(got) == len(rows) and {r["source"]: r["target"] for r in got} == goal
    assert all(abs(taken[s] - goal[s]) <= max(20, 0.01 * goal[s]) for s in goal)


def test_mix_meets_targets_and_never_repeats_more_than_allowed(spark):
    rng = random.Random(6)
    texts, sources = [], []
    for i in range(3000):
        texts.append(rng.choice([None, "", "w " * rng.randrange(1, 60)]) if i % 50 == 0 else "w " * rng.randrange(1, 60))
        sources.append("tiny" if i < 20 else None if i % 11 == 0 else rng.choice(["a", "hot", "hot", "hot"]))
    df = docs(spark, texts, sources).withColumn("size", F.lit("clash"))
    rows = mixing.mix_table(df).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_table(df.repartition(5)).collect()}
    assert len(rows) == len(texts)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == brute_targets(list(size.items()))
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 60 for s in target)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_mix_divides_equal_rows(spark, monkeypatch):
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t", "a")] * 400 + [(i, "w " * 10, "b") for i in range(10, 500)] + [(None, None, "c"), (None, "", "c"), (1, "x y", None), (1, "x y", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for pieces in (4096, 16):
        monkeypatch.setattr(mixing, "PIECES", pieces)
        got = mixing.mix_table(df).collect()
        assert len(got) == len(rows)
        taken = collections.Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
            assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        target = {r["source"]: r["target"] for r in got}
        assert all(abs(taken[x] - target[x]) <= max(20, 0.01 * target[x] if pieces > 16 else 0.05 * target[x]) for x in "ab") and 0 < target["a"] % 8000
        mixed = mixing.mix(df.withColumn("n", F.monotonically_increasing_id()).withColumn("_group", F.lit(1)))
        words = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
        assert words["a"] == taken["a"] and mixed.where("source = 'a'").groupBy("n").count().agg(F.max("count")).first()[0] - mixed.where("source = 'a'").groupBy("n").count().agg(F.min("count")).first()[0] <= 1


def brute_mix(rows, weights=(5, 2, 1), most=3.0):
    """Taken copies by source and hash order, for rows (source, size, place) of which no two are equal."""
    size = collections.Counter()
    for s, n, _ in rows:
        size[s] += n
    goal = brute_targets(list(size.items()), weights, most)
    out = {}
    for s in size:
        base = min(int(goal[s] // size[s]), int(most)) if size[s] else 0
        left, got = (goal[s] - base * size[s] if size[s] else 0), []
        own = sorted((p, n) for t, n, p in rows if t == s)
        for p, n in own:
            if left < 1 or n > left:
                break
            left -= n
            got.append(p)
        out[s] = base, got, left, goal[s]
    return out


def test_mix_equals_brute_force(spark):
    """Documents in order of their hashes up to the target; what a boundary document leaves over is filled from behind it."""
    rng = random.Random(9)
    df = docs(spark, ["w " * rng.randrange(0, 9) for _ in range(900)], [rng.choice("xyz") for _ in range(900)])
    rows = mixing.sized(df).collect()
    want = brute_mix([(r["source"], r["size"], r["place"]) for r in rows])
    of = {r["doc_id"]: r["place"] for r in rows}
    taken = collections.Counter()
    for r in mixing.mix_table(df, bits=3).collect():
        base, first, _, _ = want[r["source"]]
        taken[r["source"]] += r["taken"]
        assert r["copies"] >= base + (of[r["doc_id"]] in first)
    assert all(abs(taken[s] - goal) < 9 for s, (_, _, _, goal) in want.items())


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix_table(df).count() == 0 and mixing.mix(df).count() == 0
    one = docs(spark, ["a b c"])
    assert mixing.mix_table(one).first()["taken"] == 3


def test_large_arrow_strings_and_slices():
    a = pa.array(["ab", None, "é", ""], pa.large_string()).slice(1)
    buf, rows = textcore.flat(a)
    assert rows.tolist() == [0, 0, 2, 2] and bytes(buf) == "é".encode()
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 1000)], ["t"])
    assert sum(p.num_rows for p in textcore.batches([b], 5000)) == 1000


def test_mixture_boundaries(spark):
    kind = "doc_id long, source string, size long, place long"

    def taken(rows, left):
        df = spark.createDataFrame(rows, kind)
        other = 1000 - left
        got = mixing.mixture_plan(df.union(spark.createDataFrame([(99, "z", other, 5)], kind)), weights=(left, other), most=3)
        return mixing.with_plan(df, got).groupBy().agg({"copies": "max"}).first()[0], sum(r["copies"] * r["size"] for r in mixing.with_plan(df, got).collect()), {r["source"]: r["target"] for r in got.collect()}["a"]

    # one document of 1,000 words and a target of 900 or so: the document is nearer than nothing
    most, words, target = taken([(1, "a", 1000, 7)], 450)
    assert most == 1 and words == 1000 and abs(target - 1000) > 50
    # a group of equal rows that is too large together is not taken by a later round; a small document behind it is
    rows = [(i, "a", 100, 10) for i in range(20)] + [(50, "a", 60, 900)]
    most, words, target = taken(rows, 200)
    assert words == min(3, int(target // 60)) * 60 and 60 < target < 1000
