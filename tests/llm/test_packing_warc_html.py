"""Exact round trips of packing and archives; rendering of small pages."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldwise.llm.html_text import _aligned, extract_text, page_text
from foldwise.llm.packing import Packer, encoder, pack
from foldwise.llm.warc import new_folder, parse_record, read_record, read_seek_table, read_warc, seek_table, write_warc

from .helpers import documents, odd_texts, prose

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_both_libraries_give_equal_ids():
    both, own = encoder(VOCABULARY, RANKS), Tokenizer.from_file(VOCABULARY)
    texts = [t or "" for t in odd_texts()] + ["It's 12,345 – „quoted“ …\n\n  x", "<|endoftext|> a", "a b", "a" * 3000, "  \n\t  \n x", "ſ İ ǅ"]
    for t in texts:
        assert list(both(t)) == own.encode(t, add_special_tokens=False).ids


def test_pieces_cover_every_document_once(spark):
    texts = [*odd_texts(), *[prose(k, 3 * k) for k in range(150)]]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, "one", "s"), (None, "no id", "s")]
    docs = documents(spark, rows).repartition(5)
    got = pack(docs, vocabulary=VOCABULARY, ranks=RANKS, size=256, open_windows=4, merge_partitions=2).withColumn("crc", F.crc32("ids")).collect()
    own = Tokenizer.from_file(VOCABULARY)
    ids = {k: np.array(own.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for k, t, _ in rows}
    per_doc: dict = {}
    for r in got:
        assert r["crc"] == zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        per_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert sum(n for _, n in per_doc.pop(3)) == 2 * len(ids[3])  # the repeated row is packed for itself
    for k, pieces in per_doc.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(ids[k])
    windows: dict = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert pack(docs.limit(0), vocabulary=VOCABULARY).count() == 0


def test_packer_is_bounded_and_best_fit():
    closed = []
    p = Packer(10, 2, lambda w, pieces: closed.append(pieces))
    for name, n in (("a", 6), ("b", 7), ("c", 3), ("d", 9), ("e", 4), ("f", 8)):
        p.add(name, n)
        assert len(p.windows) <= 2
    assert closed[0] == [(0, "b"), (7, "c")]  # the fullest window that holds c, now full
    assert closed[1] == [(0, "a"), (6, "e")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "first": F.lit(1), "salt": F.lit(2)})


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr("foldwise.llm.warc.COPIES_PER_SALT", 3)
    rows = [(k, f"http://h/{k}", ["<p>same</p>", None, "", f"<p>{k} ü\r\n\r\n</p>", prose(1, 20_000)][k % 5]) for k in range(60)] + [(7, None, "<p>7</p>")]
    folder = new_folder(spark)
    index = write_warc(pages(spark, rows).repartition(4), folder, bundle_bytes=5000)
    got = read_warc(spark, folder, index).collect()
    assert len(got) == len(rows) == index.select("record_id", "bundle", "frame", "offset").distinct().count()
    first: dict = {}
    for k, _, h in rows:
        first[h or ""] = min(k, first.get(h or "", k))
    text = {(k, u or ""): h or "" for k, u, h in rows}
    for r in got:
        h = text[r["page_id"], r["url"]]
        if first[h] == r["page_id"]:
            assert r["record_type"] == "response" and bytes(r["payload"]).decode() == h and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first[h] and r["full_bytes"] == len(h.encode())
    empty = new_folder(spark)
    assert write_warc(pages(spark, rows).limit(0), empty).count() == 0


def test_one_frame_opens_alone(spark):
    import zstandard
    from pyarrow import fs

    folder = new_folder(spark)
    # Records of about 430 bytes, three to a frame.
    index = write_warc(pages(spark, [(k, "http://h", f"<p>{k}</p>") for k in range(9)]).coalesce(1), folder, frame_bytes=1500)
    row = index.where("page_id = 4").first()
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{row['bundle']}") as f:
        data = f.read()
    frames = read_seek_table(data)
    assert len(frames) == index.select("frame").distinct().count() == 3
    at, size, plain = frames[row["frame"]]
    frame = zstandard.ZstdDecompressor().decompress(data[at:at + size])
    assert len(frame) == plain <= 1500 and frame.count(b"WARC/1.1\r\n") == 3
    assert parse_record(frame[row["offset"]:row["offset"] + row["length"]])[2] == b"<p>4</p>"
    for r in index.collect():
        fields, _, payload = read_record(folder, r)
        assert (fields["X-Page-ID"], fields["WARC-Record-ID"], payload) == (str(r["page_id"]), r["record_id"], f"<p>{r['page_id']}</p>".encode())
    with pytest.raises(ValueError):
        parse_record(frame)  # several records
    with pytest.raises(ValueError):
        parse_record(frame[:-1])
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read().count(b"WARC/1.1\r\n") == 9
    assert read_seek_table(seek_table([(3, 5), (4, 6)])) == [(0, 3, 5), (3, 4, 6)]
    with pytest.raises(ValueError):
        read_seek_table(struct.pack("<IBI", 0, 0, 1))


@pytest.mark.parametrize("source,want", [
    ("", ""), ("plain", "plain"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<p>a  b\n c<p>d", "a b c\n\nd"), ("<title>t</title><div>x<div>y</div>z", "x\ny\nz"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"), ("<p>a<script>b</p></script><style>c</style>d", "ad"),
    ("<b hidden>x</b>y<i style='DISPLAY : none'>z</i>", "y"), ("<div style=visibility:hidden>a<b style=visibility:visible>b</b></div>", "b"),
    ("<table><tr><th>N<th>Quantity<tr><td>Apple<td>1<tr><td colspan=2>all</table>", "N      Quantity\nApple  1\nall"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("a &amp; b&nbsp;c &lt;d&gt; &bogus; <", "a & b c <d> &bogus; <"),
    ("<!-- x --><p>y<!-- z", "y"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<a href='>'>q</a>", "q"), ("<select><option>1<option>2</select>", "1\n2"),
    ("<dialog>secret</dialog>a<dialog open>b</dialog>", "a\nb"), ("<ruby>k<rp>(</rp><rt>r</rt><rp>)</rp></ruby>", "kr"),
    ("<table><tr><td colspan=3>a<td>b<tr><td>c<td rowspan=2 colspan=2>d\n<td>e<tr><td>f<td>g</table>", "a     b\nc  d  e\nf     g"),
    ("<table><tr><td>a<tr><td><tr><td>b</table>", "a\n\nb"),
    ("x</p>y", "x\n\ny"), ("<details>hid<summary>s</summary></details><details open>seen</details>", "s\nseen"),
])
def test_rendering(source, want):
    assert page_text(source) == want


def test_deep_and_broken_pages():
    assert page_text("<div><table><tr><td>" * 3000 + "deep").strip() == "deep"
    assert page_text("<a b='" * 5000) == ""
    assert page_text("<p " * 5000 + ">x") == "x"


def plain_table(rows):
    """Lines of a table by a grid in which every cell is filled in."""
    grid = {}
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in grid:
                c += 1
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    grid.setdefault((i, j), "")
            grid[r, c] = text
            c += across
    columns = range(1 + max((c for _, c in grid), default=-1))
    widths = [max(len(t) for (_, k), t in grid.items() if k == c) for c in columns]
    return ["  ".join(grid.get((r, c), "").ljust(widths[c]) for c in columns if widths[c]).rstrip() for r in range(len(rows))] if any(widths) else []


def test_tables_beside_a_filled_grid():
    rng = random.Random(7)
    for _ in range(400):
        rows = [[(rng.choice(["", "a", "bcd"]), rng.choice([1, 1, 2, 5]), rng.choice([1, 1, 2, 4])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 7))]
        assert _aligned(rows) == plain_table(rows), rows


def test_small_pages_with_wide_tables_and_deep_lists():
    wide = "<table><tr>" + "<td colspan=1000>x" * 200 + "<tr><td>y" * 4000 + "</table>"
    assert len(page_text(wide)) < 4 * len(wide)
    tall = "<table>" + "<tr>" + "<td rowspan=9999>x" * 1000 + "<tr><td>y" * 100 + "</table>"
    assert page_text(tall).count("y") == 100
    deep = "<ul><li>x" * 4000
    assert len(page_text(deep)) < 20 * len(deep) and page_text(deep).count("- x") == 4000


def test_extract_text_rows(spark):
    got = extract_text(pages(spark, [(1, "u", None), (1, "u", None), (2, "u", ""), (3, "u", "<p>x")])).collect()
    assert sorted(map(tuple, got), key=str) == [(1, None), (1, None), (2, ""), (3, "x")]
    assert extract_text(pages(spark, []).limit(0)).count() == 0
