"""Per-document operators beside plain definitions, on odd rows and on empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logtide.llm import langid, licenses, mjpeg, phrases, pieces, token_counts
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# -- pieces (operator 1)

@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return pieces.Codec(file.read())


def best_path(codec, text):
    """Viterbi by its definition, over a plain dict of pieces."""
    scores = {codec.names[i]: codec.scores[i] for i in range(len(codec.names))
              if not codec.is_byte[i] and codec.output[i]}
    text = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [(0.0, [])] + [None] * len(text)
    for start in range(len(text)):
        total, path = best[start]
        steps = [(text[start:end], scores[text[start:end]]) for end in range(start + 1, min(len(text), start + 17) + 1)
                 if text[start:end] in scores]
        if text[start] not in scores:
            steps.append((text[start], codec.unknown))
        for piece, score in steps:
            end = start + len(piece)
            if best[end] is None or total + score > best[end][0]:
                best[end] = (total + score, [*path, piece])
    ids = {n: i for i, n in enumerate(codec.names)}
    return [i for p in best[-1][1] for i in ([ids[p]] if p in scores else codec.fallback(p))]


@pytest.mark.parametrize("text", ["a", "The quick brown fox", "  two  spaces ", "é日本😀\n\tx", "<0x0A><s>", "a" * 300, "x▁y"])
def test_best_pieces(codec, text):
    ids = codec.encode(text)
    assert ids == best_path(codec, text)
    assert codec.decode(ids) == text.replace(pieces.MARK, " ")


def test_lockstep_and_single_paths_agree(codec):
    rng = random.Random(3)
    words = {pieces.MARK + "".join(rng.choice("abcdethé日-") for _ in range(rng.randint(1, 40))) for _ in range(400)}
    codec.learn(words)
    assert all(codec.known[w] == codec.solve(w) for w in words)


def test_pieces_of_odd_rows(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.code_texts(odd, path, with_text=True).collect()
    assert len(rows) == odd.count() and sum(r.round_trip for r in rows) == len(rows)
    assert {r.n_pieces for r in rows if r.n_chars == 0} == {0}
    assert all(len(r.ids) == r.n_pieces for r in rows)
    assert pieces.code_texts(none, path).count() == 0


# -- media (operator 2)

def test_payload_comes_back_from_stored_media(odd, none):
    rows = mjpeg.store_texts(odd, with_media=True).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is None:
            continue
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        frames = mjpeg.decode_frames(mjpeg.parse_avi(bytes(r.media)).frames)
        assert frames[:, 3::8, 4::8].tobytes() == payload
    assert mjpeg.store_texts(none).count() == 0


def test_every_byte_survives():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 192 * 40, np.uint8)) + bytes(range(192)) + b"\xff\x00" * 96
    stored, = mjpeg.encode_many([payload])
    assert mjpeg.read_back([stored])[0][0] == payload


def test_general_jpeg_blocks_decode():
    """A block with AC coefficients, coded by hand with the frame's own tables."""
    head = (b"\xff\xd8" + mjpeg.segment(0xDB, bytes([0] + [2] * 64)) + mjpeg.segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
            + mjpeg.segment(0xC4, mjpeg.huffman_body(0, (0, 2), (3, 0))) + mjpeg.segment(0xC4, mjpeg.huffman_body(0x10, (0, 3), (0, 0x02, 0x13)))
            + mjpeg.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])))
    # DC +5 (00 101), AC1 = -2 (01 01), a zero and +6 (10 110), end (00)
    bits = "00101" + "0101" + "10110" + "00"
    bits += "1" * (-len(bits) % 8)
    frame = head + bytes(int(bits[i: i + 8], 2) for i in range(0, len(bits), 8)) + b"\xff\xd9"
    coefficients = np.zeros((8, 8))
    coefficients[0, 0], coefficients[0, 1], coefficients[2, 0] = 10, -4, 12  # zigzag places 0, 1, 3, times 2
    basis = mjpeg.COSINES
    wanted = np.clip(np.rint(basis @ coefficients @ basis.T) + 128, 0, 255)
    assert (mjpeg.decode_frames([frame])[0] == wanted).all()


def test_shots_are_cut_where_pictures_change(spark):
    rng = np.random.default_rng(2)
    scenes = [rng.integers(lo, lo + 20, (n, 192)).astype(np.uint8) for lo, n in ((20, 30), (180, 25), (90, 40))]
    media, = mjpeg.encode_many([np.concatenate(scenes).tobytes()])
    frame = spark.createDataFrame([(1, media), (2, b"no avi"), (3, None)], "doc_id bigint, media binary")
    rows = sorted(tuple(r) for r in mjpeg.clips(frame).collect())
    assert [r[:4] for r in rows[:3]] == [(1, 0, 0, 29), (1, 1, 30, 54), (1, 2, 55, 94)]
    assert rows[1][4:] == (30 / 25, 55 / 25, "ok")
    assert [r[1:] for r in rows[3:]] == [(None,) * 5 + ("no_avi",)] * 2


def dc_frame(levels, colour=False, interval=0, tables=False, extra=b""):
    """A frame of flat 8 x 8 blocks, grey or with halved chrominance, by the usual Huffman tables."""
    rows, cols = levels.shape
    def words(number):
        return {symbol: format(code, f"0{bits}b") for symbol, code, bits in mjpeg.codes(*map(bytes.fromhex, mjpeg.USUAL[number]))}
    dc, ac, chroma = words(0), words(0x10), words(1)[0] + words(0x11)[0]
    order = [[(y, x)] for y in range(rows) for x in range(cols)]
    if colour:
        order = [[(y + v, x + h) for v in (0, 1) for h in (0, 1)] for y in range(0, rows, 2) for x in range(0, cols, 2)]
    out, bits, last = b"", "", 0

    def flushed():
        whole = bits + "1" * (-len(bits) % 8)
        return bytes(int(whole[i: i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")

    for k, unit in enumerate(order):
        if interval and k and k % interval == 0:
            out, bits, last = out + flushed() + bytes([0xFF, 0xD0 + (k // interval - 1) % 8]), "", 0
        for y, x in unit:
            diff = int(levels[y, x]) - 128 - last
            last += diff
            n = abs(diff).bit_length()
            bits += dc[n] + (format(diff if diff > 0 else diff + (1 << n) - 1, f"0{n}b") if n else "") + ac[0]
        bits += 2 * chroma if colour else ""
    parts = [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)] if colour else [(1, 0x11, 0)]
    head = b"\xff\xd8" + extra + mjpeg.segment(0xDB, bytes([0] + [8] * 64))
    if tables:
        head += b"".join(mjpeg.segment(0xC4, bytes([n]) + bytes.fromhex(a + b)) for n, (a, b) in mjpeg.USUAL.items())
    if interval:
        head += mjpeg.segment(0xDD, interval.to_bytes(2, "big"))
    head += mjpeg.segment(0xC0, bytes([8, 0, 8 * rows, 0, 8 * cols, len(parts), *[b for p in parts for b in p]]))
    head += mjpeg.segment(0xDA, bytes([len(parts), *[b for c, _, _ in parts for b in (c, 0 if c == 1 else 0x11)], 0, 63, 0]))
    return head + out + flushed() + b"\xff\xd9"


@pytest.mark.parametrize("options", [{}, {"colour": True}, {"interval": 5}, {"colour": True, "interval": 2}, {"tables": True},
                                     {"extra": mjpeg.segment(0xFE, b"a comment")}])
def test_frames_of_others_are_decoded(options):
    levels = np.random.default_rng(4).integers(0, 256, (5, 6, 8)).astype(np.uint8)
    frames = [dc_frame(x, **options) for x in levels]
    got, status = mjpeg.movie_levels(frames)
    assert status == ["ok"] * 5 and (got.reshape(levels.shape) == levels).all()
    assert (mjpeg.decode_frames(frames)[:, ::8, ::8] == levels).all()


def test_usual_tables_are_whole():
    for lengths, symbols in mjpeg.USUAL.values():
        counts = bytes.fromhex(lengths)
        assert sum(counts) == len(bytes.fromhex(symbols)) == len(set(bytes.fromhex(symbols)))
        assert sum(n << (16 - bits) for bits, n in enumerate(counts, 1)) < 1 << 16


def test_clips_of_broken_files(spark):
    levels = np.random.default_rng(5).integers(0, 256, (4, 6, 8)).astype(np.uint8)
    good = [dc_frame(x) for x in levels]
    whole = mjpeg.avi(good)
    progressive = good[0].replace(b"\xff\xc0", b"\xff\xc2")
    files = {
        "dropped": (mjpeg.avi([good[0], b"", good[2], good[3]]), "ok", 4),
        "mixed": (mjpeg.avi([good[0], dc_frame(levels[1], colour=True), dc_frame(levels[2], interval=3), dc_frame(levels[3], tables=True)]), "ok", 4),
        "comment": (mjpeg.avi([*good[:3], dc_frame(levels[3], extra=mjpeg.segment(0xFE, b"x"))]), "ok", 4),
        "other size": (mjpeg.avi([*good[:3], dc_frame(levels[3][:4])]), "unreadable", 4),
        "head cut": (mjpeg.avi([good[0], good[1][:30], good[2]]), "unreadable", 3),
        "data cut": (mjpeg.avi([good[0], good[1][:-12], good[2]]), "damaged", 3),
        "half": (whole[: len(whole) // 2], None, None),
        "progressive": (mjpeg.avi([progressive]), "unreadable", None),
        "nothing": (mjpeg.avi([]), "no_frames", None),
        "noise": (b"RIFF\xff\xff\xff\x7fAVI " + bytes(range(256)), "no_avi", None),
    }
    frame = spark.createDataFrame([(n, f) for n, (f, _, _) in files.items()], "doc_id string, media binary")
    rows = {}
    for r in mjpeg.clips(frame).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for name, (_, status, frames) in files.items():
        got = rows[name]
        assert status is None or {r.status for r in got} == {status}, name
        if frames:
            assert max(r.last_frame for r in got) == frames - 1, name
        elif status:
            assert [r.clip for r in got] == [None], name
    shown, status = mjpeg.movie_levels([b"", good[1], b"", good[1][:30], good[3]])
    assert status == ["empty", "ok", "empty", "unreadable", "ok"]
    assert (shown.reshape(-1, 6, 8) == levels[[1, 1, 1, 1, 3]]).all()


# -- languages (operator 3)

def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = langid.identify(docs, ~held_out, held_out=held_out, lang=F.col("lang")).filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9


def test_language_of_odd_rows(odd, none):
    rows = langid.identify(odd, F.lit(True)).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred in ("en", "de", "ja", "und") and 0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.rejected for r in rows if r.doc_id in (2, 3, 4, 7))
    assert langid.identify(none, F.lit(True)).count() == 0
    unlearned = langid.identify(odd, F.lit(False)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}
    assert langid.accepted(odd, F.lit(True)).columns == odd.columns


# -- phrases (operator 5)

def test_equal_substrings_share_phrases():
    rng = np.random.default_rng(5)
    body = bytes(rng.integers(97, 123, 4_000, np.uint8))
    other = bytes(rng.integers(97, 123, 4_000, np.uint8))
    plain, moved, strange = phrases.sketches([body, b"some words first, " + body, other])
    assert phrases.likeness(plain, moved) > 0.9 and phrases.likeness(plain, strange) < 0.1
    assert (phrases.sketches([b"x", body, b"", b"tail"])[1] == plain).all()
    assert all(len(phrases.sketches([t])[0]) for t in (b"a", b"aa", b"ab" * 50, b" " * 3_000))


def test_compare_with_next_row(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    old, phrases.RANGE_ROWS = phrases.RANGE_ROWS, 30
    try:
        got = by_id(phrases.compare_with_next(docs.repartition(5)))
    finally:
        phrases.RANGE_ROWS = old
    assert len(got) == len(texts)
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        row = got[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        mine, edit, following = phrases.sketches([text.encode(), changed.encode(), after.encode()])
        assert (row.fingerprint, row.edited_fingerprint) == (phrases.text_of(mine), phrases.text_of(edit))
        assert (row.near_edited, row.near_next) == (phrases.likeness(mine, edit), phrases.likeness(mine, following))
    assert phrases.compare_with_next(odd).count() == odd.count()
    assert phrases.compare_with_next(none).count() == 0
    assert phrases.compare_with_next(odd.filter("doc_id = 8")).first().near_next == 1.0


def test_next_documents_by_ids_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_ROWS", 30)
    ids = [s * (2**62 + 7_919_000_003 * i * i) for i in range(1, 150) for s in (1, -1)] + [2**63 - 1, -2**63]
    rows = [(k, f"text number {i} of many, " * (2 + i % 5)) for i, k in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges in one task hide what is lost between them
    try:
        found = phrases.compare_with_next(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows.sort()
    wanted = {k: phrases.edited(t, after) for (k, t), (_, after) in zip(rows, [*rows[1:], rows[0]])}
    assert len(found) == len(rows)
    assert {r.doc_id: r.edited_sha256 for r in found} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in wanted.items()}


# -- token counts (operator 8)

@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        return token_counts.Counter(file.read())


def test_counts_are_the_librarys(counter):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    alphabet = "abcdeilnorst 'éüß\n\t!?0<|>İΣ日😀́\x1c"
    texts = ["", "''s 'SUNDAY don't I'LL !'s", "<|endoftext|>x<|startoftext|>", "ΑΣ ΣΑΣ ǅ ﬁ", "a" * 3_000, "a\x85b\x1fc\x00",
             *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(1_500))]
    for text in texts:
        wanted = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == wanted, text
        assert counter.count(text, stretch=7) == wanted, text


def test_token_counts_of_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = by_id(token_counts.count_tokens(odd, path))
    assert (rows[2].n_tokens, rows[3].n_tokens, rows[4].n_tokens) == (0, 0, 0)
    assert rows[6].n_tokens == 4_000 and rows[6].over_limit and not rows[1].over_limit
    assert token_counts.count_tokens(none, path).count() == 0


# -- licences (operator 9)

def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i: i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places(spark, odd, none):
    scanner = licenses.Scanner()
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["cc by cc by-CC BY", "the mit license's mit  LICENSE", "gnu general public", "apache-license"]
    assert all(scanner.scan(t)[:5] == plain_scan(t) for t in texts)
    rows = by_id(licenses.scan_licenses(odd))
    assert (rows[3].n_words, rows[3].first_word, rows[3].labels, rows[3].score) == (0, None, "", 0.0)
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("line, labels, score", [
    ("MIT", "mit", 0.9),
    ("(MIT OR GPL-3.0-only) AND Apache-2.0", "apache,gpl,mit", 0.9),
    ("MIT AND GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl,mit", 0.5),
    ("CC0-1.0 OR MIT AND GPL-2.0", "cc0,gpl,mit", 1.0),
    ("MIT and some prose", "mit", 0.9),
    ("Custom-1.0", "custom", 0.2),
    ("(MIT", "", 0.0),
    ("", "", 0.0),
])
def test_licence_expressions(line, labels, score):
    found = licenses.Scanner().scan(f"# SPDX-License-Identifier: {line}\nnext line")
    assert found[5] == labels and found[6] == pytest.approx(score)


@pytest.mark.parametrize("line, labels, score", [
    ("Zlib", "zlib", 0.2),
    ("Unlicense\r", "unlicense", 0.2),
    ("MIT OR Unlicense", "mit,unlicense", 0.9),
    ("MIT AND Zlib", "mit,zlib", 0.2),
    ("MIT and (Zlib or Ruby)", "mit,ruby,zlib", 0.2),
    ("GPL-2.0 WITH Bootexception", "gpl", 0.5),
    ("MIT.", "mit", 0.9),
    ("GPL-2.0. AND so on", "gpl", 0.4),
    ("(MIT OR Zlib.) AND Vim", "mit,vim,zlib", 0.2),
    ("MIT or whatever", "mit", 0.9),
    ("NOASSERTION", "", 0.0),
])
def test_licence_names_of_any_letters(line, labels, score):
    found = licenses.Scanner().scan(f"# SPDX-License-Identifier: {line}\nnext line")
    assert found[5] == labels and found[6] == pytest.approx(score)

