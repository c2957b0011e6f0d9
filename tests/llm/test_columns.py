"""Media, sharding, quality, chat, tokens, languages and mixing: round trips, brute force and hard cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quotelake.llm import chat_format, jump_sharding, language_id, mixing, mpeg_audio, quality, sentencepiece_fst, templates

DOCS = "doc_id long, text string, lang string, source string, size int, score double, shard int, ids int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 0, 0.0, 0, 0) for d, t, lang, s in rows], DOCS)


ODD = [(1, None, "en", None), (2, "", "en", "s"), (3, " \t\n", None, "s"), (None, "a b c", "en", "s"), (4, "x" * 300_000, "en", "s"), (5, "é 日本 \U0001f600", "fr", "t"), (5, "é 日本 \U0001f600", "fr", "t")]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=2000))
def test_media_round_trip(text):
    payload = mpeg_audio.pad(text.encode("utf-8", "ignore"))
    media = mpeg_audio.encode(payload)
    s = mpeg_audio.parse(media)
    assert mpeg_audio.decode(media) == payload
    assert s.bad == 0 and s.junk == 0 and s.table["frames"] == len(s.offsets) and s.checked == len(s.offsets) + 1
    assert s.microseconds == len(s.offsets) * 384 * 1_000_000 // 48_000


def layer3(kbps_index, payload=b"", protected=False, mono=False):
    head = bytes([0xFF, 0xFA if protected else 0xFB, kbps_index << 4, 0xC0 if mono else 0x00])
    h = mpeg_audio.header(head)
    side = bytes(mpeg_audio._side_bytes(h))
    body = head + (mpeg_audio.crc16(head[2:] + side).to_bytes(2, "big") if protected else b"") + side
    return (body + payload).ljust(h.size, b"\0")


def test_reader_resynchronises_reads_tags_and_tables():
    xing = b"Xing" + (7).to_bytes(4, "big") + (3).to_bytes(4, "big") + (999).to_bytes(4, "big") + bytes(range(100))
    title = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\x03hello"
    tag = b"ID3\x03\0\0" + bytes([0, 0, 0, len(title)]) + title
    frames = [layer3(9, xing), layer3(9, protected=True), layer3(5, protected=True), layer3(9)]
    v1 = b"TAG" + b"old title".ljust(125, b"\0")
    data = tag + frames[0] + frames[1] + b"junk\xff\xe0junk" + frames[2] + frames[3] + v1
    s = mpeg_audio.parse(data)
    assert s.tags["TIT2"] == "hello" and s.tags["id3v1_title"] == "old title"
    assert s.table["kind"] == "Xing" and s.table["frames"] == 3 and len(s.table["toc"]) == 100
    assert len(s.offsets) == 3 and s.samples == 3 * 1152 and s.junk == 10 and (s.checked, s.bad) == (2, 0)
    assert [data[o : o + 2] for o in s.offsets] == [b"\xff\xfa", b"\xff\xfa", b"\xff\xfb"]
    broken = bytearray(data)
    broken[s.offsets[0] + 8] ^= 1
    assert mpeg_audio.parse(bytes(broken)).bad == 1


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600))
def test_reader_never_fails_on_noise(data):
    mpeg_audio.parse(data)
    mpeg_audio.parse(b"ID3\x04\0\0\0\0\0\x30" + data)


@pytest.mark.parametrize("mark,back", [(b"TAG", 128), (b"APETAGEX", 32)])
def test_texts_that_look_like_tags_are_kept(mark, back):
    """The mark stands so many bytes before the stream's end, wherever the payload reaches there, in last frames of every size."""
    met = 0
    for size in range(64, 64 * 19, 64):
        media = bytearray(mpeg_audio.encode(b"x" * size))
        at = len(media) - back
        if media[at : at + len(mark)] != b"x" * len(mark):
            continue
        payload = bytearray(b"x" * size)
        frames = mpeg_audio.parse(bytes(media)).offsets
        rest = size - 384 * (len(frames) - 1)
        offset = size - rest + at - frames[-1] - 22 - mpeg_audio._subbands(rest) * 6 // 8
        for length in (0, 60, 900, 1 << 24):
            payload[offset : offset + len(mark)] = mark
            if mark == b"APETAGEX" and offset + 16 <= size:
                payload[offset + 12 : offset + 16] = (length & 0x7F7F7F7F).to_bytes(4, "little")
            stream = mpeg_audio.encode(bytes(payload))
            assert stream[at : at + len(mark)] == mark
            s = mpeg_audio.parse(stream)
            assert mpeg_audio.decode(stream, s) == payload and s.junk == 0
        met += 1
    assert met


def test_text_that_looks_like_a_tag_fails_no_query(spark):
    text = "x" * (384 - 110) + "TAG" + "y" * 107
    got = mpeg_audio.media_features(spark, docs_frame(spark, [(1, text, "en", "s")])).collect()
    assert [(r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in got] == [(1, 384, 384)]


def test_real_tags_after_frames_are_still_read():
    media = mpeg_audio.encode(mpeg_audio.pad(b"some text"))
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(4) + b"\0\0\0\0" + bytes(8)
    for tail in (b"TAG" + b"Title".ljust(125, b"\0"), ape, ape + b"TAG" + b"Title".ljust(125, b"\0")):
        s = mpeg_audio.parse(media + tail)
        assert s.junk == 0 and mpeg_audio.decode(media + tail, s) == mpeg_audio.pad(b"some text")
        assert s.tags.get("id3v1_title") == ("Title" if b"Title" in tail else None)


def test_media_rows(spark):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in mpeg_audio.media_features(spark, docs_frame(spark, ODD)).collect()}
    for d, t, *_ in ODD:
        body = (t or "").encode()
        padded = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        r = rows[d, len(body)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert mpeg_audio.media_features(spark, docs_frame(spark, [])).count() == 0
    probed = mpeg_audio.probe_media(spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xfb")), (3, bytearray(layer3(9) * 2))], "doc_id long, media binary")).collect()
    assert [r["frames"] for r in sorted(probed, key=lambda r: r["doc_id"])] == [0, 0, 2]


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_walk(spark):
    r = random.Random(2)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(r.randrange(-(2**63), 2**63) for _ in range(300))]
    for n in (1, 2, 24, 25, 100):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_sharding.jump_hash(jump_sharding.F.col("k"), n).alias("b")).collect()
        assert all(x["b"] == jump(x["k"], n) for x in got)


def test_sharding_rows(spark):
    rows = ODD + [(i, f"t{i}", "en", "s") for i in range(10, 900)]
    got = jump_sharding.shard_documents(spark, docs_frame(spark, rows), 24, bucket_rows=5).collect()
    assert len(got) == len(rows)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got)
    sizes = {(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == sizes
    assert jump_sharding.shard_documents(spark, docs_frame(spark, []), 24).count() == 0


def test_slots_follow_the_ids_at_every_size(spark):
    rows = [(k * 37 % 1000, f"t{k % 7}", "en", "s") for k in range(1000)] + [(5, "same", "en", "s")] * 50 + [(None, f"n{k}", "en", "s") for k in range(30)]
    got = jump_sharding.shard_documents(spark, docs_frame(spark, rows), 3, bucket_rows=40).collect()
    assert len(got) == len(rows)
    for shard in range(3):
        own = [r for r in got if r["shard"] == shard]
        in_order = sorted(own, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["slot"]))
        assert [r["slot"] for r in in_order] == list(range(len(own)))


def test_quality_learns_and_is_honest(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for d in range(600):
        bad = d % 4 == 0
        rows.append((d, " ".join((word().upper() + "!!") if bad else word() for _ in range(40)), "en", "s"))
        if d % 2 == 0 or d % 3 == 0:
            labels.append((d, 0 if bad else 1, 0))
    frame = docs_frame(spark, rows + ODD[:4])
    table = spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(spark, frame, table).collect() if r["doc_id"] is not None}
    assert sum((got[d]["predicted"] == 0) == (d % 4 == 0) for d in range(600)) > 590
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in range(600))
    # labels of held-out rows teach nothing
    flipped = spark.createDataFrame([(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, 0) for d, q, _ in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(quality.train(frame, flipped), quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality_scores(spark, frame, none).collect()} == {0.5}
    assert quality.keep_good(spark, frame, table).columns == frame.columns


def test_quality_scores_are_dot_products():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = [b"a b a b b", b"", None, b"One two!"]
    places, bounds = quality.features(texts)
    assert np.diff(bounds).tolist() == [18, 0, 0, 6]
    for i in range(4):
        own = places[bounds[i] : bounds[i + 1]]
        alone, _ = quality.features([texts[i]])
        assert own.tolist() == alone.tolist()
    # the words and pairs of words themselves, hashed one by one
    mask = (1 << 64) - 1

    def place(x, salt):
        x = (x + salt * 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) >> (64 - quality.BITS)

    h = [xxhash.xxh64_intdigest(x) for x in texts[0].split()]
    want = [place(x, 0) for x in h] + [place((a * 0x9E3779B97F4A7C15 + b) & mask, 3) for a, b in zip(h, h[1:], strict=False)]
    first = places[: bounds[1]].tolist()
    assert all(first.count(p) >= want.count(p) for p in want)


def test_quality_scores_of_the_table(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in quality.score(spark, docs_frame(spark, ODD + [(9, "One two! one two", "en", "s")]), w).collect()}
    for d, t, *_ in ODD[:3] + [(9, "One two! one two")]:
        places, _ = quality.features([(t or "").encode()])
        logit = float(w[-1]) + sum(float(w[p]) for p in places.tolist()) / max(1, len(places)) ** 0.5
        assert got[d] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_ftrl_step_equals_the_published_update():
    rng = np.random.default_rng(3)
    z, n = rng.normal(size=6), rng.random(6)
    at, x = np.array([1, 3, 4]), np.array([0.5, 0.25, 1.0])
    weight = lambda z, n: 0.0 if abs(z) <= quality.L1 else -(z - (1 if z > 0 else -1) * quality.L1) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
    p = 1 / (1 + np.exp(-sum(weight(z[i], n[i]) * v for i, v in zip(at, x, strict=True))))
    want_z, want_n = z.copy(), n.copy()
    for i, v in zip(at, x, strict=True):
        g = (p - 1.0) * v
        want_z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * weight(z[i], n[i])
        want_n[i] += g * g
    quality.ftrl_step(z, n, at, x, 1.0)
    assert np.allclose(z, want_z) and np.allclose(n, want_n)


def test_templates():
    run = lambda s, **env: templates.compile_template(s)(env)
    assert run("{% for m in ms -%}\n {{ loop.index }}{{ m.x|upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"x": "a"}, {"x": None}])[0] == "1A,2"
    assert run("a{% generation %}b{{ x ~ 1 }}{% endgeneration %}c", x="é") == ("abé1c", [(1, 2), (2, 4)])
    assert run("{% set y = x if x > 2 else 'no' %}{{ y }}{# gone #}", x=1)[0] == "no"
    assert run("{% if a == 'b' or not c %}1{% elif c in 'cd' %}2{% else %}3{% endif %}", a="x", c="d")[0] == "2"
    assert templates.parse("{% if 1 == 2 %}x{% else %}{{ 'a' + 'b' }}{% endif %}", templates.FILTERS) == [("text", "ab")]
    assert run("{{ x | default('none') }}{{ x.y | length if x else 0 }}", x=None)[0] == "none0"
    for bad in ("{{ x.__class__ }}", "{{ ().mro }}", "{{ f(1) }}", "{% for a %}{% endfor %}", "{% if x %}", "{{ x | nothing }}", "{% do x %}", "{{ _x }}"):
        with pytest.raises(templates.TemplateError):
            run(bad, x="text")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_end|>", "", "\x1b"]), st.text(max_size=40) | st.sampled_from(["<|im_start|>a<|im_sep|>", "\x1bc<s>\x1be", "<</s>", "<|im_end|>\n<|im_end|>"])), max_size=6))
def test_chat_reads_back(turns):
    render = templates.compile_template(chat_format.TEMPLATE, {"escape": chat_format.escape})
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat_format.read_back(text) == turns
    assert "".join(chat_format.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "assistant", "</s>"), (2, 0, "assistant", "</s>"), (None, 0, "user", "q")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_digest(spark, frame).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nx\nuser\n\nassistant\nb\n").hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[2]["loss_sha256"]) == (2, 8, hashlib.sha256(b"</s></s>").hexdigest())
    assert got[None]["n_turns"] == 1
    assert chat_format.format_digest(spark, frame.where("false")).count() == 0


def test_tokens_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    t = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(open(sentencepiece_fst.MODEL_PATH, "rb").read()))
    r = random.Random(1)
    signs = "ab  ▁\n\té日本語\U0001f600theingation.,!_(0123\x00 "
    for k in range(1500):
        text = " " * (k % 40) + "".join(r.choice(signs) for _ in range(r.randrange(0, 60)))
        assert t.encode(text) == sp.encode(text), text
        assert t.decode(t.encode(text)) == sp.decode(sp.encode(text))
    long = "x" * 3000 + " " * 500 + "y"
    assert t.encode(long) == sp.encode(long)
    for ids in ([0], [1, 300, 2], [258, 300, 233], []):
        assert t.decode(ids) == sp.decode(ids)
    got = sentencepiece_fst.encode_documents(spark, docs_frame(spark, ODD)).collect()
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str(sp.encode(t or "")) for _, t, *_ in ODD)
    assert all(r["lossless"] for r in got)
    assert sentencepiece_fst.encode_documents(spark, docs_frame(spark, [])).count() == 0


def merged(text, scores):
    """Plain merging of a whole text: the best-scored neighbours first, the leftmost of equals."""
    parts = list(text)
    while True:
        best = max(((scores[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc▁", min_size=2, max_size=5), max_size=25, unique=True), st.lists(st.integers(1, 12), min_size=25, max_size=25), st.text("abc▁d", max_size=24))
def test_merge_paths_equal_plain_merging(longer, ranks, text):
    """Any merge model, with pieces that are never reached, equal scores, and merges out of their scores' order."""
    own = [("<unk>", 0.0, 2), *((c, -20.0, 1) for c in "abc▁"), *((p, -float(r), 1) for p, r in zip(longer, ranks, strict=False))]
    t = sentencepiece_fst.Transducer(sentencepiece_fst.Model(own, kind=sentencepiece_fst.BPE))
    scores = {p: s for p, s, k in own if k == 1 and len(p) > 1}
    if text:
        assert t._shortest(text) == merged(text, scores)
        # all stretches at once
        parts = [text, text[::-1], text[: len(text) // 2] or "a", "c"]
        ids, counts = sentencepiece_fst._MergeArcs(t).written(parts)
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == list(t._written(text)) and ids.tolist() == [i for x in parts for i in t._written(x)]


def test_merge_model_equals_plain_merging():
    t = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(open(sentencepiece_fst.MODEL_PATH, "rb").read()))
    scores = {p: s for p, s in t.scores.items() if len(p) > 1}
    r = random.Random(5)
    pieces = [p for p in scores if len(p) < 8]
    for _ in range(400):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 8))) + r.choice(["", "é", "日", "\n"])
        want = [i for p in merged(text, scores) for i in (t.ids[p] if p in t.ids else [t.bytes[b] for b in p.encode()])]
        assert list(t._written(text)) == want, text
        assert t.arcs.written([text])[0].tolist() == want, text


def test_remembered_paths_are_bounded():
    found = sentencepiece_fst._Remembered(len, 10)
    assert [found["x" * (k % 40)] for k in range(400)] == [k % 40 for k in range(400)]
    assert len(found) + len(found.older) <= 11 and found["y" * 100] == 100 and "y" * 100 not in found


def test_unigram_shortest_path_equals_brute_force():
    model = sentencepiece_fst.Model([("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -1.5, 1), ("ab", -2.0, 1), ("ba", -2.1, 1), ("aba", -3.2, 1), ("▁", -0.5, 1), ("▁a", -1.2, 1)])
    t = sentencepiece_fst.Transducer(model)
    arcs = {p: s for p, s, k in model.pieces if k == 1}

    def best(text):
        if not text:
            return 0.0
        return max(arcs[p] + best(text[len(p) :]) for p in arcs if text.startswith(p))

    for text in ("ab", "aba", "abab", "babaabb", "▁abaab"):
        path = t._shortest(text)
        assert "".join(path) == text and sum(arcs[p] for p in path) == pytest.approx(best(text))
    assert t.encode("a z") == [7, 6, 0]


def test_language_profiles(spark):
    en, fr = ["the", "and", "with", "thing", "of"], ["le", "été", "que", "où", "françois"]
    r = random.Random(0)
    rows = [(d, " ".join(r.choice(en if d % 2 else fr) for _ in range(30)), "en" if d % 2 else "fr", "s") for d in range(200)]
    frame = docs_frame(spark, rows + [(900, None, "en", "s"), (901, "12 !", "en", "s"), (902, "", None, "s"), (None, "the thing", None, "s"), (903, "the " * 50_000, None, "s")])
    got = {r["doc_id"]: r for r in language_id.predict_languages(spark, frame).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang, _ in rows)
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in range(200))
    assert language_id.predict_languages(spark, docs_frame(spark, [])).count() == 0


def test_languages_equal_plain_counting(spark):
    """Learning, cosines and the best language, worked out trigram by trigram."""
    r = random.Random(2)
    words = {"en": ["the", "and", "with", "thing"], "fr": ["été", "que", "où", "le"], "de": ["über", "und", "die", "ß"]}
    rows = [(d, " ".join(r.choice(words[lang]) for _ in range(r.randrange(1, 12))), lang, "s") for d in range(60) for lang in [r.choice(list(words))]]
    rows += [(100, "the été und", None, "s"), (101, "xyz", None, "s")]
    letters = language_id.letter_vectors().astype(int)

    def vector(text):
        signs = [0]
        for c in [*(ord(c) for c in text), 0]:
            low = ord(chr(c).lower()[0])
            sign = (low - 96 if 97 <= low <= 122 else 27 + low % (language_id.SIGNS - 27)) if chr(c).isalpha() else 0
            if sign or signs[-1]:
                signs.append(sign)
        out = np.zeros(language_id.DIM)
        for a, b, c in zip(signs, signs[1:], signs[2:], strict=False):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    prototypes = {}
    for d, t, lang, _ in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2:
            prototypes[lang] = prototypes.get(lang, 0) + vector(t)
    got = {x["doc_id"]: x for x in language_id.predict_languages(spark, docs_frame(spark, rows)).collect()}
    for d, t, *_ in rows:
        v = vector(t)
        cosine = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in prototypes.items()}
        best = max(cosine.values())
        assert got[d]["score"] == pytest.approx(min(1, max(0, best)), abs=1e-6)
        assert cosine[got[d]["lang_pred"]] == pytest.approx(best, abs=1e-9)


def test_hypervectors_equal_plain_sums():
    owner, gram = language_id.trigrams([b"ab a", b"", "é".encode()])
    v = language_id.letter_vectors().astype(int)
    want = np.zeros((3, language_id.DIM))
    for o, g in zip(owner, gram, strict=True):
        a, b, c = g // 4096, g // 64 % 64, g % 64
        want[o] += np.roll(np.roll(v[a], 1), 1) * np.roll(v[b], 1) * v[c]
    assert np.array_equal(language_id.text_vectors(owner, gram, 3), want)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_targets_and_rows(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 30))), "en", r.choice(["b", "a", "é", None, "Z", "zz"])) for i in range(3000)]
    rows += [(5000, None, "en", "empty"), (None, "a b", "en", "a"), rows[0]]
    got = mixing.mixing_report(spark, docs_frame(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    source = {d: s for d, _, _, s in rows}
    taken = {}
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s], abs=1e-6) and x["taken"] in (0, x["size"], 2 * x["size"])
        taken[s] = taken.get(s, 0) + x["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.15 * t + 60
    again = mixing.mixing_report(spark, docs_frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix_documents(spark, docs_frame(spark, rows))
    assert mixed.columns == docs_frame(spark, rows).columns
    assert mixed.count() == sum(x["taken"] // x["size"] for x in got if x["size"]) + mixed.where("doc_id = 5000 or trim(coalesce(text, '')) = ''").count()
    assert mixing.mixing_report(spark, docs_frame(spark, [])).count() == 0


def test_stretches_of_one_hash_are_compared(monkeypatch):
    """With a hash that knows only lengths every stretch meets others."""
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    with open(sentencepiece_fst.MODEL_PATH, "rb") as f:
        t = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(f.read()))
    unique = np.unique
    monkeypatch.setattr(sentencepiece_fst.np, "unique", lambda x, **kw: unique(x % np.uint64(3), **kw) if kw.get("return_inverse") else unique(x, **kw))
    texts = ["one two three four", "", "five six seven eight nine ten", "a b c d e f g"]
    ids, ends = t.encode_all(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [sp.encode(x) for x in texts]


def test_bytes_that_are_no_text_are_stored_with_replacements(spark):
    docs = spark.sql("select 1L doc_id, cast(x'ff41' as string) text union all select 2L, '�A' union all select 3L, cast(x'41e2' as string)")
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"], r["feature"]) for r in mpeg_audio.media_features(spark, docs).collect()}
    assert got[1] == got[2] and got[1][0] == 4 and got[3][0] == 4
    assert all(len(r["seek"]) == r["frames"] for r in mpeg_audio.media_features(spark, docs).collect())


def test_slots_are_the_same_whatever_the_ranges(spark):
    docs = docs_frame(spark, [(i % 37, f"text {i % 11}", "en", "s") for i in range(300)])
    rows = lambda **kw: sorted(map(tuple, jump_sharding.shard_documents(spark, docs, 5, **kw).collect()))
    assert rows(bucket_rows=10) == rows(bucket_rows=10, most_ranges=3) == rows()
