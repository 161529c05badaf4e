"""The ten operators and the pipeline: against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text of exactly seven words here"), (6, "same text of exactly seven words here"), (7, "x " * 30000), (None, "no key"), (9, "é ß ñ 漢字 😀 #$%"), (9, "é ß ñ 漢字 😀 #$%")]


def odd_docs(spark):
    rows = [(k, t, None, "s", None, 5) for k, t in ODD]
    return spark.createDataFrame(rows, DOC + ", score int")


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(seed, n, vocabulary=300, low=20, high=120):
    r = random.Random(seed)
    names = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(names) for _ in range(r.randint(low, high))) for _ in range(n)]


class TestKernel:
    def test_words_hash_alike_wherever_they_stand(self):
        from vigilia.llm import textbytes as t

        texts = ["ab cd  ab\nef", "", "ab", " cd ", "né ab né", None]
        data, at = t.text_buffers(pa.array(texts))
        starts, ends, first = t.word_bounds(data, at)
        got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        assert got == [w for x in texts for w in words(x)]
        assert np.diff(first).tolist() == [len(words(x)) for x in texts]
        hashes = t.word_hashes(data, starts, ends)
        assert all((hashes[i] == hashes[j]) == (got[i] == got[j]) for i in range(len(got)) for j in range(len(got)))
        assert int(hashes[0]) == t.hash_word("ab")

    def test_shingles_and_sets(self):
        from vigilia.llm import textbytes as t

        ws = np.arange(1, 12, dtype=np.uint64)
        first = np.array([0, 7, 7, 9, 11])
        runs, at = t.shingle_hashes(ws, first, 5)
        assert np.diff(at).tolist() == [3, 0, 1, 1]
        values, counts, begin = t.sorted_sets(np.array([3, 1, 3, 2, 2, 2], np.uint64), np.array([0, 3, 3, 6]))
        assert values.tolist() == [1, 3, 2] and counts.tolist() == [1, 2, 3] and begin.tolist() == [0, 2, 2, 3]

    def test_index(self):
        from vigilia.llm.textbytes import HashIndex, mix

        keys = mix(np.arange(1, 5000, dtype=np.uint64))
        index = HashIndex(keys[:3000])
        assert index.find(keys).tolist() == [*range(3000), *[-1] * 1999]
        assert HashIndex(keys[:0]).find(keys[:3]).tolist() == [-1] * 3

    def test_folding(self):
        from vigilia.llm.textbytes import folded

        assert bytes(folded(np.frombuffer("ÀÉÑ×ß Zz".encode(), np.uint8))).decode() == "àéñ×ß zz"


#: (page, the texts of its article)
HAND = [
    ("<article><p>Para one is here.</p><button>Subscribe now</button><p>Para two is here.</p></article>", ["Para one is here.", "Para two is here."]),
    ("<p>The ferry left at noon.</p><p>It came back at night.</p>", ["The ferry left at noon.", "It came back at night."]),
    ("<html><body><h1>Short news</h1><p>Rain fell.</p></body></html>", ["Short news", "Rain fell."]),
    ("<body><div id=wrap><ul class=nav><li><a href=/>Home</a><li><a href=/n>News</a></ul><div class=story><h2>Bridge opens</h2><p class=by>By A. Writer</p><p>The new bridge opened on Monday after two years of work.</p><p>Drivers were pleased.</p></div><div id=foot>All rights reserved</div></div>",
     ["Bridge opens", "By A. Writer", "The new bridge opened on Monday after two years of work.", "Drivers were pleased."]),
    ("<main><h1>Soup</h1><ul><li>Two onions</li><li>One leek</li></ul><ol><li>Cut them.</li><li>Boil them for an hour.</li></ol></main><footer><p>Made with care</p><a href=/c>Contact</a></footer>", ["Soup", "Two onions", "One leek", "Cut them.", "Boil them for an hour."]),
    ("<header><a href=/>The Daily</a><form><input name=q><button>Search</button></form></header><main><article><h1>Storm</h1><p>A storm hit the coast last night, and many roads are closed.</p><div class='share'><a href=/t>Tweet</a> <a href=/f>Share</a></div><p>Schools stay shut until Thursday.</p></article></main><aside><h3>Most read</h3><ul><li><a href=/1>Cat saved</a></li></ul></aside>",
     ["Storm", "A storm hit the coast last night, and many roads are closed.", "Schools stay shut until Thursday."]),
    ("<div class='cookies'><p>We value your privacy.</p><button>Accept</button></div><div class='content'><p>He walked to the river.</p><blockquote>Nobody knew why.</blockquote><p>Then he came home.</p></div><section class='comments'><h3>2 comments</h3><p>Great read!</p><p>I did not like it.</p></section>",
     ["He walked to the river.", "Nobody knew why.", "Then he came home."]),
    ("<table><tr><td><a href=/a>Index</a></td><td><font size=3>Our club met in May. Ten people came.</font><p>Next time we meet in June.</p></td></tr></table>", ["Our club met in May. Ten people came.", "Next time we meet in June."]),
    ("<nav><a href=/>Start</a></nav><article><header><h1>On stones</h1><p>By Jo</p></header><p>Stones are old.</p><figure><img src=x><figcaption>A stone.</figcaption></figure><pre>weigh(stone)</pre><table><tr><td>Granite</td><td>hard</td></tr></table></article><footer>© 2021</footer>",
     ["On stones", "By Jo", "Stones are old.", "A stone.", "weigh(stone)", "Granite", "hard"]),
    ("<div class=page><div class=hd>My site</div><div class=bd><p>First thoughts on tea.</p><p>Tea is best hot, they say, though some like it cold.</p><form class=newsletter><p>Get our letter</p><button>Join</button></form><p>Last thoughts.</p></div></div>",
     ["First thoughts on tea.", "Tea is best hot, they say, though some like it cold.", "Last thoughts."]),
    ("<section><h1>FAQ</h1><dl><dt>Is it free?</dt><dd>Yes, it is free for all.</dd><dt>Can I leave?</dt><dd>At any time.</dd></dl></section>", ["FAQ", "Is it free?", "Yes, it is free for all.", "Can I leave?", "At any time."]),
    ("<article class=post><h2><a href=/p>Morning walk</a></h2><time>3 May</time><p>We saw <a href=/d>two deer</a> near the old mill.</p><p>Tags: <a href=/t>walks</a></p></article><div class=pagination><a href=/2>Older</a></div>", ["Morning walk", "3 May", "We saw two deer near the old mill."]),
]


class TestHtml:
    PAGE = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>menu</a></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text.<p>Second&nbsp;one, unclosed.<script>var x='<p>no</p>'</script></article><section id='comments'><p>I like it.</p></section><footer>&copy; me</footer>"
    )

    def test_blocks(self):
        from vigilia.llm.html_text import blocks_of

        assert [b.text for b in blocks_of(self.PAGE)] == ["menu", "We use cookies.", "A & B", "First bold text.", "Second one, unclosed.", "I like it.", "© me"]
        assert blocks_of("<p>broken <b") and blocks_of("") == [] and blocks_of("<!-- only") == []
        assert [b.text for b in blocks_of("<p hidden>no</p><p>yes<br>two</p><div style='display: none'>no</div>")] == ["yes two"]

    def test_broken_heads_and_unclosed_elements(self):
        from vigilia.llm.html_text import blocks_of

        text = lambda page: [b.text for b in blocks_of(page)]
        assert text("<html><head><title>x</title><meta charset=utf-8><body><article><p>Hello") == ["Hello"]
        assert text("<head><title>x</title><style>p{}</style><p>Hello</p>") == text("<head><title>x</title>Hello") == text("<head> <link rel=x> </head>Hello") == ["Hello"]
        assert text("<p>a</p><video src=x><p>b</p><canvas><p>c") == ["a", "b", "c"]
        assert text("<p>a</p><video src=x>old browser</video><p>b</p><video><p>c<video>no</video><svg>d") == ["a", "b", "c", "d"]

    def test_odd_pages(self, spark):
        from vigilia.llm.html_text import extract

        body = "<article>" + "".join(f"<p>The sentence of number {i} stands here, as do others.</p>" for i in range(20000)) + "</article>"
        rows = [("a", body), ("a", body), (None, "<head><article><p>One whole sentence stands in this article."), ("z", None)]
        pages = spark.createDataFrame([(k, f"<html><body>{b}</body>" if b else None, 1, 2) for k, b in rows], "text string, _body string, n_chars int, html int")
        got = extract(pages, ["text", "html"], "_body")
        assert got.columns == ["html", "text", "n_chars"]
        sizes = sorted(r.n_chars for r in got.collect())
        assert sizes[0] == 0 and 40 < sizes[1] < 60 and sizes[2] == sizes[3] == sum(len(f"The sentence of number {i} stands here, as do others.") + 2 for i in range(20000)) - 2

    def test_held_out_pages(self):
        from vigilia.llm.html_text import blocks_of, fit_extractor, labelled_pages, main_text, page_features

        model = fit_extractor(300)
        wrong = total = 0
        for page, good in labelled_pages(80, seed=991):
            blocks = blocks_of(page)
            for block, label in zip(blocks, model.decode(page_features(blocks))):
                total += 1
                wrong += label != (block.text in good)
        assert wrong / total < 0.03
        assert main_text(self.PAGE, model) == "A & B\n\nFirst bold text.\n\nSecond one, unclosed."
        assert main_text(None, model) == ""

    def test_pages_of_another_origin(self):
        """Twelve pages written and labelled by hand: with buttons between paragraphs, by-lines, short articles, no container at all."""
        from vigilia.llm.html_text import blocks_of, fit_extractor, main_text, page_features

        model, found, right, there = fit_extractor(), 0, 0, 0
        for page, good in HAND:
            blocks = blocks_of(page)
            got = [b.text for b, on in zip(blocks, model.decode(page_features(blocks))) if on]
            found, right, there = found + len(got), right + sum(t in good for t in got), there + len(good)
        assert right / there > 0.95 and right / found > 0.9
        assert main_text(HAND[0][0], model) == "Para one is here.\n\nPara two is here."
        assert main_text(HAND[1][0], model) == "The ferry left at noon.\n\nIt came back at night."

    def test_kept_columns_in_capitals(self, spark):
        from vigilia.llm.html_text import extract

        pages = spark.createDataFrame([(1, "x", "<article><p>One whole sentence stands here.</p></article>" * 2)] * 2, "page_id long, Text string, html string")
        got = extract(pages, ["page_id", "Text"], "html")
        assert got.columns == ["page_id", "text", "n_chars"] and {r.text for r in got.collect()} == {"\n\n".join(["One whole sentence stands here."] * 2)}

    def test_viterbi_is_the_best_labelling(self):
        from vigilia.llm.html_text import NEW, SAME, ChainCRF

        r = random.Random(3)
        model = ChainCRF()
        model.weights = {f"f{i}": r.uniform(-2, 2) for i in range(8)}
        model.first, model.step = [r.uniform(-1, 1) for _ in "ab"], [[[r.uniform(-1, 1) for _ in "ab"] for _ in "ab"] for _ in "ab"]
        for _ in range(20):
            sequence = [[r.choice([SAME, NEW]), f"f{r.randrange(8)}"] for _ in range(7)]
            value = lambda y: model.first[y[0]] + sum(model.weights[f[1]] * b for f, b in zip(sequence, y)) + sum(model.step[f[0] == NEW][a][b] for a, b, f in zip(y, y[1:], sequence[1:]))
            assert value(model.decode(sequence)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=7))))

    def test_rows(self, spark):
        from vigilia.llm.html_text import extract

        rows = spark.createDataFrame([(1, "u", self.PAGE, 1), (2, None, None, 2), (None, "v", "", 3), (4, "w", "plain", 4)], "page_id long, url string, html string, text int")
        got = {r.url: r for r in extract(rows, ["page_id", "url"], "html").collect()}
        assert got["u"].text.startswith("A & B") and got["u"].n_chars == len(got["u"].text) and got[None].text == "" and got["v"].n_chars == 0
        assert extract(rows.limit(0), ["page_id", "url"], "html").count() == 0


class TestWarc:
    def pages(self, spark):
        r = random.Random(1)
        body = ["same", "same", "same", "", None, "é" * 1000, "\r\n\r\nWARC/1.1\r\n", "".join(chr(r.randrange(32, 1000)) for _ in range(5000))]
        return spark.createDataFrame([(i, f"http://x/{i}\nz", b, 7) for i, b in enumerate(body)], "page_id long, url string, html string, records int"), body

    def test_round_trip_whatever_the_ranges(self, spark):
        from vigilia.llm.warc import read_warc, with_revisits, write_warc
        from vigilia.llm.common import shared_dir

        pages, body = self.pages(spark)
        files = write_warc(with_revisits(pages, "page_id", "url", "html").coalesce(1), shared_dir(spark))
        for split in (37, 500, 1 << 20):
            rows = read_warc(files, split).collect()
            got = {int(r.record_id[9:]): r for r in rows}
            assert len(rows) == len(body) and all(r.digest_ok is not False for r in rows)
            for i, text in enumerate(body):
                raw = (text or "").encode()
                assert got[i].payload_bytes == len(raw) and got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
                assert got[i].record_type == ("revisit" if i in (0, 1, 3) else "response")
                assert got[i].payload is None if i in (0, 1, 3) else bytes(got[i].payload) == raw
            assert got[0].refers_to == got[1].refers_to == "urn:page:2" and got[3].refers_to == "urn:page:4"

    def read(self, spark, tmp_path, raw, split):
        from vigilia.llm.warc import read_warc

        path = tmp_path / f"{hashlib.md5(raw).hexdigest()}.warc.gz"
        path.write_bytes(raw)
        files = spark.createDataFrame([(f"file://{path}", len(raw))], "path string, bytes long")
        return sorted(r.record_id for r in read_warc(files, split).collect())

    def test_bytes_between_and_after_records(self, spark, tmp_path):
        from vigilia.llm.warc import encode_record

        a, b, c = (encode_record(f"urn:page:{i}", "u", bytes([65 + i]) * (300 * i), "X", None) for i in (1, 2, 3))
        want = ["urn:page:1", "urn:page:2", "urn:page:3"]
        for raw in (a + b + c, b"junk\x1f\x8b\x08" + a + b"some junk" + b + b"\x1f\x8b\x08\x00torn" + c + b"\n", a + b"\n" + b + bytes(700) + c + b"\r\n\r\n"):
            for split in (90, 10_000):
                assert self.read(spark, tmp_path, raw, split) == want
        broken = bytearray(b)
        broken[-6] ^= 1  # its CRC
        assert self.read(spark, tmp_path, a + bytes(broken) + c, 10_000) == self.read(spark, tmp_path, a + b[: len(b) // 2] + c, 80) == ["urn:page:1", "urn:page:3"]

    def test_members_inside_a_payload(self, spark, tmp_path):
        from vigilia.llm.warc import encode_record

        inner = b"".join(encode_record(f"urn:page:{i}", None, random.Random(i).randbytes(200), "X", None) for i in (7, 8, 9))
        stored = zlib.compressobj(0, zlib.DEFLATED, 31)
        outer = stored.compress(zlib.decompress(encode_record("urn:page:1", "u", inner, "Y", None), 31)) + stored.flush()
        after = encode_record("urn:page:2", "u", b"after", "Z", None)
        for raw in (outer + after, outer + b"junk" + after, after + outer):
            for split in (61, 400, 10_000):
                assert self.read(spark, tmp_path, raw, split) == ["urn:page:1", "urn:page:2"]

    def test_lengths(self, spark, tmp_path):
        from vigilia.llm.warc import encode_record

        def member(text):
            deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
            return deflate.compress(text) + deflate.flush()

        plain = zlib.decompress(encode_record("urn:page:1", "u", b"body", "X", None), 31)
        short, odd, none = plain.replace(b"Content-Length: ", b"Content-Length: 9"), plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 2), plain.replace(b"page:1", b"page:2")
        assert self.read(spark, tmp_path, b"".join(map(member, (short, odd, none))), 50) == ["urn:page:2"]

    def test_odd_rows(self, spark):
        from vigilia.llm.warc import archive, page_ids

        rows = [(None, None, "a"), (5, "u", "a"), (5, "u", "a"), (3, "v", "x" * 3_000_000), (4, "v", None), (None, "w", None)]
        pages = spark.createDataFrame([(*r, "k", "p") for r in rows], "page_id long, url string, html string, k string, payload string")
        got = page_ids(archive(pages, "page_id", "url", "html"), "page_id").collect()
        assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == {
            (None, 1, "revisit", 5): 1, (5, 1, "response", None): 2, (3, 3_000_000, "response", None): 1, (4, 0, "response", None): 1, (None, 0, "revisit", 4): 1
        }

    def test_empty(self, spark):
        from vigilia.llm.warc import archive

        assert archive(self.pages(spark)[0].limit(0), "page_id", "url", "html").count() == 0


class TestPacking:
    def test_pieces_and_offsets(self, spark):
        import public_tokenizers
        from tokenizers import Tokenizer

        from vigilia.llm.packing import pack

        path = public_tokenizers.path("word_bpe_49k.json")
        tokenizer = Tokenizer.from_file(path)
        texts = [(i, t) for i, t in enumerate(random_texts(5, 120, low=1, high=900))] + [(500, None), (501, ""), (502, "Don't STOP!! l'été <|endoftext|> x²　y 12ab"), (503, "w " * 9000)]
        docs = spark.createDataFrame([(*x, 1) for x in texts], "doc_id long, text string, start int")
        rows = pack(docs, "doc_id", "text", path, length=1024).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        for k, text in texts:
            ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for r in sorted(by[k], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        assert sorted(sequences) == list(range(len(sequences)))
        for parts in sequences.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 1024
        total = sum(r.length for r in rows)
        assert len(sequences) * 1024 < 1.12 * total

    def test_ids_of_odd_texts(self, monkeypatch):
        import public_tokenizers
        from tokenizers import Tokenizer

        from vigilia.llm import packing
        from vigilia.llm.textbytes import text_buffers

        path = public_tokenizers.path("word_bpe_49k.json")
        tokenizer, r = Tokenizer.from_file(path), random.Random(4)
        signs = "abXY 12'|<>#é É×\n\t中😀ßñ́-_.,!  "
        texts = ["<|endoftext|>a <|startoftext|>", "a\tb\r\nc\x0bd\x0ce\x1ff\x00g", "you're 's 'lL don’t", "ﬁ Ⅷ ½ İ ſ K", "", "'", *("".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(500))]

        def same(encoder):
            for at in range(0, len(texts), 40):
                ids, first = encoder.encode(*text_buffers(pa.array(texts[at : at + 40])))
                for i, text in enumerate(texts[at : at + 40]):
                    assert ids[first[i] : first[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids

        same(packing.WordEncoder(path, 300))  # emptied again and again
        hashes = packing.word_hashes
        monkeypatch.setattr(packing, "word_hashes", lambda *a: hashes(*a) % np.uint64(64) + np.uint64(1))  # nearly all hashes are shared
        same(packing.WordEncoder(path))

    def test_inverse_without_a_library(self):
        from vigilia.llm.packing import _inverted

        matrix = np.random.default_rng(2).integers(0, 5, (40, 40)) + np.eye(40)
        assert np.allclose(_inverted(matrix) @ matrix, np.eye(40))

    def test_hot_rows_and_clashing_names(self, spark, monkeypatch):
        import public_tokenizers

        from vigilia.llm import packing

        monkeypatch.setattr(packing, "RANKED_ROWS", 10)
        docs = spark.createDataFrame([(None if i % 3 else "k", "the same words", i) for i in range(200)], "_key string, _text string, length int")
        got = packing.pack(docs, "_key", "_text", public_tokenizers.path("word_bpe_49k.json"), length=64, grid=4).collect()
        assert len(got) == 200 and len({(r.sequence_id, r.offset) for r in got}) == 200 and {r.length for r in got} == {4}
        assert len({r.sequence_id for r in got}) == math.ceil(200 / 16) == max(r.sequence_id for r in got) + 1

    @pytest.mark.parametrize("text, ids", [("word", 2), ("one two three", 4), (None, 1)])
    def test_short_documents_fill_their_sequences(self, spark, text, ids):
        import public_tokenizers

        from vigilia.llm.packing import pack

        docs = spark.range(5000).select(F.col("id").alias("start"), F.lit(text).cast("string").alias("text"))
        got = pack(docs, "start", "text", public_tokenizers.path("word_bpe_49k.json")).cache()
        assert got.columns == ["start", "start_", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]  # the key is named like a result
        assert got.agg(F.sum("length")).first()[0] == 5000 * ids and got.select("sequence_id", "offset").distinct().count() == 5000
        assert got.agg(F.max("sequence_id")).first()[0] + 1 == math.ceil(5000 * ids / 4096)  # no fewer are possible
        assert got.groupBy("sequence_id").agg((F.max(F.col("offset") + F.col("length")) - F.sum("length")).alias("gap")).where("gap <> 0").count() == 0

    def test_bundles_lose_little(self):
        from vigilia.llm.packing import BUNDLE, bundled

        counts = {n: 1000 for n in [1, 2, 3, 5, 17, 100, 255, 333, 401, 700, 1023, 2047, 4096]}
        items, demand = bundled(counts, 16)
        for size, (each, full, _, _) in items.items():
            rest = counts[size] - full * each
            assert full * each + rest == counts[size] and (rest < each) and (each == 1 or each * size <= BUNDLE)
        assert sum(c * n for c, n in demand.items()) * 16 < 1.006 * sum(size * n for size, n in counts.items())

    def test_column_generation_meets_the_bound(self):
        from vigilia.llm.packing import round_patterns, solve_patterns

        sizes, demand = np.array([3, 4, 5, 7]), np.array([97, 61, 40, 20])
        solved = solve_patterns(sizes, demand.astype(float), 16)
        value = sum(a for _, a in solved)
        assert value >= (sizes @ demand) / 16 - 1e-9
        plan = round_patterns(sizes, demand, 16, solved)
        assert sum(t for _, t in plan) <= math.ceil(value) + len(sizes)
        cover = np.zeros(4, int)
        for pattern, times in plan:
            assert sum(sizes[i] * n for i, n in pattern) <= 16
            for i, n in pattern:
                cover[i] += n * times
        assert (cover >= demand).all()

    def test_odd_rows(self, spark):
        import public_tokenizers

        from vigilia.llm.packing import pack

        path = public_tokenizers.path("word_bpe_49k.json")
        assert pack(odd_docs(spark), "doc_id", "text", path).groupBy().sum("length").first()[0] > 0
        assert pack(empty_docs(spark), "doc_id", "text", path).count() == 0


def labelled(n, seed):
    """Texts of which some hold words that only toxic texts have."""
    r = random.Random(seed)
    out = []
    for i, text in enumerate(random_texts(seed, n)):
        bad = r.random() < 0.25
        parts = text.split()
        for _ in range(4 if bad else 0):
            parts.insert(r.randrange(len(parts)), r.choice(["zzvile", "zzfoul", "zzgrim"]))
        out.append((i, " ".join(parts), int(bad)))
    return out


class TestToxicity:
    def test_held_out_texts(self, spark):
        from vigilia.llm.toxicity import toxicity

        rows = labelled(600, 4)
        docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
        got = toxicity(docs, labels, "doc_id", "text", "toxic").toPandas().set_index("doc_id")
        held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
        assert all(got.held_out[r[0]] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
        assert sum(got.predicted[r[0]] == r[2] for r in held) / len(held) > 0.95
        assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()

    def test_repeated_keys_and_string_keys(self, spark):
        from vigilia.llm.toxicity import fit_toxicity, score_texts

        rows = [(f"k{k}", t, y) for k, t, y in labelled(300, 6)]
        docs = spark.createDataFrame([(k, t, "x", "y") for k, t, _ in rows] + [(rows[0][0], rows[0][1], "x", "y")] * 3000, "id string, text string, score string, _text string")
        labels = spark.createDataFrame([(k, y) for k, _, y in rows], "id string, toxic int")
        model = fit_toxicity(docs, labels, "id", "text", "toxic")
        once = fit_toxicity(docs.dropDuplicates(), labels, "id", "text", "toxic")
        assert (model.slope, model.intercept, model.chosen) == (once.slope, once.intercept, once.chosen)
        few = fit_toxicity(docs, labels, "id", "text", "toxic", most_words=500)
        assert few.words.size < model.words.size
        got = score_texts(docs, model, "text", ["id", "score", "_text"])
        assert got.columns == ["id", "_text", "score", "predicted"] and got.count() == 3300

    def test_held_out_labels_do_not_matter(self, spark):
        from vigilia.llm.toxicity import toxicity

        rows = labelled(200, 8)
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
        flip = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in rows]
        a, b = (toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int"), "doc_id", "text", "toxic").toPandas().sort_values("doc_id").score.tolist() for x in ([(k, y) for k, _, y in rows], flip))
        assert a == b

    def test_odd_rows(self, spark):
        from vigilia.llm.toxicity import toxicity

        labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
        assert toxicity(odd_docs(spark), labels, "doc_id", "text", "toxic").count() == len(ODD)
        assert toxicity(odd_docs(spark), labels.limit(0), "doc_id", "text", "toxic").where("score = 0").count() == len(ODD)
        assert toxicity(empty_docs(spark), labels, "doc_id", "text", "toxic").count() == 0


class TestLanguage:
    def docs(self, spark, n=240):
        r = random.Random(2)
        sound = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ein tz pf".split(), "cc": "ção ñe ll rr é".split()}
        rows = []
        for i in range(n):
            lang = r.choice(list(sound))
            rows.append((i, " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang if i % 11 else None, lang))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string"), rows

    def test_held_out_texts(self, spark):
        from vigilia.llm.language import identify

        docs, rows = self.docs(spark)
        got = {r.doc_id: r for r in identify(docs, "doc_id", "text", "lang").collect()}
        held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
        assert all(got[x[0]].held_out == (zlib.crc32(str(x[0]).encode()) % 3 == 1) for x in rows)
        assert sum(got[x[0]].lang_pred == x[3] for x in held) / len(held) > 0.95

    def test_repeated_keys_and_clashing_names(self, spark):
        from vigilia.llm.language import TRAIN_WINDOWS, fit_language, predict

        docs, rows = self.docs(spark, 60)
        docs = docs.withColumn("k", F.col("doc_id").cast("string")).withColumn("score", F.lit("x"))
        many = docs.unionByName(docs.where("doc_id = 5").select("*", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("col"))
        a, b = fit_language(docs, "k", "text", "lang"), fit_language(many, "k", "text", "lang")
        assert all(np.array_equal(a.p[n], b.p[n]) for n in a.p) and TRAIN_WINDOWS == 6
        got = predict(docs, a, "text", ["k", "score"], ("lang_pred", "p"))
        assert got.columns == ["k", "score", "lang_pred", "p"] and got.where("score = 'x'").count() == 60

    def test_gradients(self):
        from vigilia.llm.language import WINDOW, ByteCNN

        model = ByteCNN(["a", "b", "c"])
        r = np.random.default_rng(0)
        grid, target = r.integers(0, 200, (6, WINDOW)), np.array([0, 1, 2, 0, 1, 2])
        for k in model.p:
            model.p[k] = model.p[k].astype(np.float64)
        model.mask = model.mask.astype(np.float64)

        def loss():
            flat = model._unfold(grid)
            h = np.maximum((flat.reshape(-1, flat.shape[2]) @ model.p["filters"]).reshape(6, -1, len(model.p["bias"])).max(axis=1) + model.p["bias"], 0)
            z = h @ model.p["out"] + model.p["out_bias"]
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), target]).mean())

        g = model.gradients(grid, target)
        for name, at in (("out", (3, 1)), ("bias", (5,)), ("filters", (0, 2)), ("embed", (int(grid[0, 3]), 1))):
            keep = model.p[name][at]
            model.p[name][at] = keep + 1e-6
            up = loss()
            model.p[name][at] = keep - 1e-6
            down = loss()
            model.p[name][at] = keep
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-4)

    def test_tables_equal_the_product(self):
        from vigilia.llm.language import _FOLD, WINDOW, ByteCNN

        model = ByteCNN(["a", "b"])
        grid = _FOLD[np.random.default_rng(1).integers(0, 256, (20, WINDOW))]
        flat = model._unfold(grid.astype(np.int64))
        want = np.maximum((flat.reshape(-1, flat.shape[2]) @ model.p["filters"]).reshape(20, -1, len(model.p["bias"])).max(axis=1) + model.p["bias"], 0)
        assert np.allclose(model.pooled(grid), want, atol=1e-5)

    def test_odd_rows(self, spark):
        from vigilia.llm.language import identify

        got = identify(odd_docs(spark), "doc_id", "text", "lang").collect()
        assert len(got) == len(ODD) and {r.lang_pred for r in got} == {"und"}
        docs, _ = self.docs(spark, 60)
        more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(900, "123 !?", "aa"), (901, None, "aa")], "doc_id long, text string, lang string"))
        assert {r.doc_id for r in identify(more, "doc_id", "text", "lang").where("lang_pred = 'und'").collect()} == {900, 901}
        assert identify(empty_docs(spark), "doc_id", "text", "lang").count() == 0


class TestQuality:
    def brute(self, text):
        w = words(text)
        counts = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if counts[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)

    def test_statistics(self, spark):
        from vigilia.llm.quality import DecisionList, judge

        r = random.Random(9)
        texts = [None, "", "\n \n", "a\na\n a\n\na", "x y " * 9, "😀 #é|"] + [" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(60)] + [" ".join(random_texts(3, 3)) * 2]
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
        for row in judge(docs, DecisionList(()), "doc_id", "text").collect():
            want = self.brute(texts[row.doc_id])
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
            assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and row.kept == (not row.base_failed)

    def test_learned_list(self):
        from vigilia.llm.quality import FEATURES, learn_list

        r = np.random.default_rng(0)
        table = {f: r.uniform(0, 1, 3000) for f in FEATURES}
        bad = (table["symbol_share"] > 0.8) | ((table["word_length"] < 0.3) & (table["upper_share"] > 0.7))
        rules = learn_list(table, bad)
        flagged = np.zeros(3000, bool)
        for rule in rules.rules:
            on = np.ones(3000, bool)
            for test in rule:
                on &= test.rows(table)
            flagged |= on
        assert (flagged == bad).mean() > 0.95 and len(rules.rules) <= 4 and "reject" in str(rules)

    def test_learned_verdicts_row_by_row(self, spark):
        """The list that the labels teach, as a Spark expression, against the same list applied to each row's statistics in numpy."""
        from vigilia.llm.quality import FEATURES, fit_rules, judge, with_statistics

        r = random.Random(5)
        texts = [(i, t + " #*!" * (r.randint(8, 20) if i % 4 == 0 else 0)) for i, t in enumerate(random_texts(21, 400, low=15, high=60))]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in texts], "doc_id long, quality int")
        rules = fit_rules(docs, labels, "doc_id", "text", "quality")
        rows = {x.doc_id: x for x in with_statistics(docs, "text").collect()}
        table = {f: np.array([rows[i][f] for i, _ in texts], float) for f in FEATURES}
        bad = np.zeros(len(texts), bool)
        for rule in rules.rules:
            bad |= np.logical_and.reduce([t.rows(table) for t in rule])
        got = {x.doc_id: x for x in judge(docs, rules, "doc_id", "text").collect()}
        assert rules.rules and all(got[i].kept == (not got[i].base_failed and not bad[i]) for i, _ in texts)
        assert np.mean(bad == np.array([i % 4 == 0 for i, _ in texts])) > 0.95

    def test_emitted_expression_and_native_plan(self, spark):
        from vigilia.llm.quality import DecisionList, Test, fit_rules, judge

        docs = spark.createDataFrame([(i, t) for i, t in enumerate(["#a #b " * 15, " ".join(random_texts(1, 1))])], "doc_id long, text string")
        out = judge(docs, DecisionList(((Test("symbol_share", True, 0.5),),)), "doc_id", "text")
        assert {r.doc_id: r.rule for r in out.collect()} == {0: 1, 1: 0}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        labels = spark.createDataFrame([], "doc_id long, quality int")
        assert fit_rules(docs, labels, "doc_id", "text", "quality").rules == ()

    def test_odd_rows(self, spark):
        from vigilia.llm.quality import DecisionList, judge

        assert judge(odd_docs(spark), DecisionList(()), "doc_id", "text").count() == len(ODD)
        names = spark.createDataFrame([("a", "one two", 1), ("a", "one two", 1), (None, None, 1)], "_words string, body string, n_words int")
        assert sorted((r._words or "", r.n_words) for r in judge(names, DecisionList(()), "_words", "body").collect()) == [("", 0), ("a", 2), ("a", 2)]
        assert judge(empty_docs(spark), DecisionList(()), "doc_id", "text").count() == 0


class TestLanguageModel:
    def test_base_score(self, spark, monkeypatch):
        from vigilia.llm import lm

        monkeypatch.setattr(lm, "HEAD_WORDS", 40)  # most words take the way through the join
        texts = [(i, t) for i, t in enumerate([None, "", "A a É", *random_texts(6, 60)])]
        docs = spark.createDataFrame([(*x, 1.0) for x in texts], "doc_id long, text string, score double")
        got = {r.doc_id: r for r in lm.score_corpus(docs, "doc_id", "text").collect()}
        lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        tokens = {k: [*words(lower(t)), None] for k, t in texts}
        counts = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
        n, v = sum(counts.values()), len(counts)
        for k, ws in tokens.items():
            assert got[k].base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
            assert got[k].score < 0 and got[k].held_out == (zlib.crc32(str(k).encode()) % 10 == 0)

    def test_probabilities_sum_to_one(self):
        from vigilia.llm.lm import CLASSES, LIMIT, LogBilinear

        model = LogBilinear(np.arange(10, 200, dtype=np.uint64), np.arange(190, 0, -1), 50.0)
        before = np.array([3, 7, 1])
        ids = np.concatenate([np.append(before, w) for w in range(LIMIT)])
        first = np.arange(0, len(ids) + 1, 4)
        last = model.log10(ids, first).reshape(-1, 4)[:, 3]
        assert CLASSES**2 == LIMIT and (10.0**last).sum() == pytest.approx(1, abs=1e-4)

    def test_training_beats_the_base_on_held_out_texts(self, spark):
        from vigilia.llm.lm import score_corpus

        docs = spark.read.parquet(f"{SF}/documents.parquet")
        got = score_corpus(docs, "doc_id", "text").where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
        assert got[0] > got[1]

    def test_training_sees_every_text(self, spark):
        from vigilia.llm.lm import score_corpus

        # The first key as text holds 620,000 tokens; what the other texts alone teach is that "q" is followed by "z".
        r = random.Random(2)
        long = " ".join(r.choice("abcdqz") for _ in range(620_000))
        docs = [(1, long), *((i, "q z " * 200) for i in range(2, 400))]
        tests = [(i, t) for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0 for t in ["q z " * 50]]
        assert zlib.crc32(b"1") % 10 and tests
        got = score_corpus(spark.createDataFrame(docs + tests, "doc_id long, text string").repartition(4), "doc_id", "text").where("doc_id >= 1000 AND held_out").collect()
        assert len(got) == len(tests) and all(r.score / r.n_tokens > -0.4 for r in got)

    def test_odd_rows(self, spark):
        from vigilia.llm.lm import score_corpus

        assert score_corpus(odd_docs(spark), "doc_id", "text").count() == len(ODD)
        assert score_corpus(empty_docs(spark), "doc_id", "text").count() == 0
        names = spark.createDataFrame([("a", "one two three", 1, 2), ("a", "one two three", 1, 2), (None, None, 1, 2)], "row string, _text string, c int, score int")
        got = score_corpus(names, "row", "_text").collect()
        assert [r.row for r in sorted(got, key=lambda r: r.n_tokens)] == [None, "a", "a"] and {r.n_tokens for r in got} == {1, 4} and len({r.score for r in got}) == 2

    def test_dealt_ids_are_those_of_all_texts(self, spark):
        from vigilia.llm.lm import LogBilinear, _dealt, tokens

        texts = ["a b a", "", "c d e f a", "zz", "a " * 3000]
        known, counts = np.unique(tokens(np.frombuffer(b"a b c d e f", np.uint8), np.array([0, 11]))[0], return_counts=True)
        model = LogBilinear(known, counts, 1.0)
        rows = _dealt(model, spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "text string, turn int").repartition(2)).collect()
        got = collections.Counter()
        for r in rows:
            ids, at = np.frombuffer(r.ids, np.uint16), 0
            for n in np.frombuffer(r.sizes, np.int64):
                got[r.turn, tuple(ids[at : at + n].tolist())] += 1
                at += n
            assert at == len(ids)
        one = lambda t: tuple(model.ids(tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]).tolist())
        assert got == collections.Counter((i % 3, one(t)) for i, t in enumerate(texts))

    def test_more_passes_learn_more(self, spark):
        from vigilia.llm.lm import score_texts

        docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
        sums = [score_texts(docs, "doc_id", "text", F.lit(True), ["doc_id"], passes=n).agg(F.sum("score"), F.sum("base_score")).first() for n in (1, 3)]
        assert sums[0][0] < sums[1][0] and sums[0][1] == pytest.approx(sums[1][1])

    def test_stretches_have_the_contexts_of_their_rows(self):
        """The shifted vectors give each token the prediction of the up to CONTEXT tokens before it in its row."""
        from vigilia.llm.lm import CONTEXT, LogBilinear

        r = np.random.default_rng(4)
        model = LogBilinear(np.arange(10, 200, dtype=np.uint64), np.arange(190, 0, -1), 50.0)
        model.p["place"] = r.normal(size=model.p["place"].shape).astype(np.float32)
        sizes = [1, 2, 3, 0, 9, 1, 30]
        ids, first = r.integers(0, 190, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
        behind, missing = model._before(ids, first)
        got = model._predicted(model.p["left"][behind], missing)
        for row, (a, b) in enumerate(zip(first[:-1], first[1:])):
            for i in range(a, b):
                want = sum(model.p["left"][ids[i - j]] * model.p["place"][j - 1] for j in range(1, CONTEXT + 1) if i - j >= a)
                assert np.allclose(got[i], want, atol=1e-5)


class TestDecontamination:
    def brute(self, docs, items, threshold=0.5):
        """(doc, item) -> score, by BM25 as it stands in books, over every pair of neighbouring stretches."""
        entries = [(k, words(t.lower())) for k, t in items]
        n, mean, width = len(entries), sum(len(w) for _, w in entries) / len(entries), max(len(w) for _, w in entries)
        df = collections.Counter(w for _, ws in entries for w in set(ws))

        def weights(ws):
            tf = collections.Counter(ws)
            return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in tf.items()}

        scored, out = [(k, weights(ws)) for k, ws in entries], {}
        for d, text in docs:
            ws = words(text.lower())
            for at in range(0, len(ws), width):
                here = set(ws[at : at + 2 * width])
                for k, by in scored:
                    score = sum(v for w, v in by.items() if w in here) / sum(by.values())
                    if score >= threshold:
                        out[d, k] = max(out.get((d, k), 0), score)
        return out

    def cases(self):
        r = random.Random(4)
        items = list(enumerate(random_texts(11, 150, 400, 10, 50)))
        docs = []
        for i in range(60):
            parts = words(items[r.randrange(150)][1])
            parts = [w for w in parts if r.random() < 0.7]
            docs.append((i, " ".join([*random_texts(i, 1, 400), *parts, *random_texts(i + 1000, 1, 400)])))
        return docs, items

    def test_retrieval_against_bm25_of_all_pairs(self, spark):
        from vigilia.llm import decontaminate as d
        from vigilia.llm.textbytes import text_buffers

        docs, items = self.cases()
        shared = d.indexes(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
        index, keys = shared[0].value
        data, at = text_buffers(pa.array([t for _, t in docs]))
        starts, ends, first = d.word_bounds(data, at, d.BREAK)
        got = {(r, keys[i].as_py()): s for r, i, s in index.passages(d.word_hashes(data, starts, ends), first, 0.5)}
        want = self.brute(docs, items)
        assert len(shared) == 1 and got.keys() == want.keys() and len(want) > 40
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)

    def test_rows_do_not_depend_on_the_parts(self, spark, monkeypatch):
        from vigilia.llm import decontaminate as d

        docs, items = self.cases()
        docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(str(k), t) for k, t in items], "item_id string, text string")
        rows = lambda: sorted(map(tuple, d.contaminated(docs, items, "doc_id", "text").collect()))
        one, left = rows(), sorted(r.doc_id for r in d.drop_contaminated(docs, items, "text").collect())
        monkeypatch.setattr(d, "PART_BYTES", 100_000)
        assert len(d.indexes(items, "item_id", "text")) > 3
        assert rows() == one and one and left == sorted(r.doc_id for r in d.drop_contaminated(docs, items, "text").collect())
        assert set(left) == set(range(60)) - {r[0] for r in one}

    def test_odd_rows(self, spark):
        from vigilia.llm import decontaminate as d

        item = "The long road to the north is closed in winter. Use the old bridge by the mill then."
        bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, "seven words that nobody has written yet", "y")], "text int, _t string, score string")
        long = " ".join(random_texts(3, 400, low=200, high=300))
        docs = [("a", f"{long} {item} {long}"), ("a", f"{long} {item} {long}"), (None, item), ("b", None), ("c", ""), ("d", long)]
        frame = spark.createDataFrame([(*x, 0, 0) for x in docs], "_k string, body string, text int, item_id int")
        got = collections.Counter((r._k, r.text) for r in d.contaminated(frame, bench, "_k", "body", "text", "_t").collect())
        assert got == {("a", 1): 4, (None, 1): 2}
        assert sorted(r._k for r in d.drop_contaminated(frame, bench, "body", "text", "_t").collect()) == ["b", "c", "d"]
        assert d.contaminated(frame, bench.limit(0), "_k", "body", "text", "_t").count() == 0 and d.drop_contaminated(frame, bench.limit(0), "body", "text", "_t").count() == len(docs)
        assert d.drop_contaminated(frame.limit(0), bench, "body", "text", "_t").count() == 0

    def test_planted_items(self, spark):
        from vigilia.llm.decontaminate import contaminated, drop_contaminated

        items = ["What is the colour of the sky? It is mostly blue by day.", "Één lange zin zonder einde over het weer in Gent", "short", None, ""]
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        pad = random_texts(7, 2)
        docs = [(1, f"{pad[0]} {items[0].upper()} {pad[1]}"), (2, pad[0]), (3, None), (4, ""), (5, "What is the colour of the sky? I do not know at all, my dear."), (6, "x!! " + items[1].replace(" ", "!! ")), (None, items[0])]
        frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
        got = {(r.doc_id, r.item_id) for r in contaminated(frame, bench, "doc_id", "text").collect()}
        assert got == {(1, 0), (6, 1), (None, 0)}
        assert {r.doc_id for r in drop_contaminated(frame, bench, "text").collect()} == {2, 3, 4, 5}
        assert contaminated(frame, bench.limit(0), "doc_id", "text").count() == 0 and contaminated(frame.limit(0), bench, "doc_id", "text").count() == 0

    def test_short_closing_sentences(self, spark):
        from vigilia.llm.decontaminate import contaminated

        body = "A farmer keeps nine red hens and four brown cows in one narrow barn by the river. How many legs do all of these animals have together?"
        items = [f"{body} It is thirty four.", "Name the tall grey tower on the hill above our town. Ask whom you like, old or young. Old Saint Martin tower.", f"Which planet {' '.join(f'p{i}' for i in range(30))}? Mars."]
        pad = random_texts(7, 2)
        half = "Name the tall grey tower on the hill above our town."
        docs = [
            (1, f"{pad[0]} {items[0].replace('four.', 'five.')} {pad[1]}"),  # one word changed
            (2, f"{pad[0]} {body} {pad[1]}"),  # less the closing sentence
            (3, f"{pad[0]} {items[1].replace('Saint Martin', 'SaintMartin')} {pad[1]}"),  # two words joined
            (4, f"{pad[0]} {items[2].replace('Mars.', '')} {pad[1]}"),
            (5, f"{pad[0]} {half} {pad[1]} Old Saint Martin"),  # a part of the question, and the answer far off
        ]
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, "doc_id", "text").collect()}
        assert got == {(1, 0), (2, 0), (3, 1), (4, 2)}


class TestNearDuplicates:
    def brute(self, rows, least=0.8):
        sets = {}
        for k, t in rows:
            w = re.findall(r"[^\W_]+", (t or "").lower())
            sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("text", t)}
        parent = {k: k for k in sets}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in itertools.combinations(sets, 2):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        return {k: find(k) for k in sets}

    def texts(self):
        r = random.Random(12)
        base, out = random_texts(13, 25, 2000, 60, 160), []
        for text in base:
            parts = text.split()
            for _ in range(r.randint(1, 8)):
                copy = parts[:]
                for _ in range(r.randint(0, max(1, len(parts) // 60))):
                    copy[r.randrange(len(copy))] = "edited"
                out.append(" ".join(copy))
            chain = parts
            for _ in range(3):  # each a little further from the first
                chain = [w if r.random() > 0.01 else "drift" for w in chain]
                out.append(" ".join(chain))
        return list(enumerate(out + ["a b", "a b", "A, b!", ""]))

    def test_against_brute_force(self, spark):
        from vigilia.llm.neardup import near_duplicates

        rows = self.texts()
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, class_id int"), "doc_id", "text").collect()}
        assert got == self.brute(rows)

    def test_large_bucket(self, spark, monkeypatch):
        from vigilia.llm import neardup as n

        monkeypatch.setattr(n, "SMALL_BUCKET", 4)
        rows = self.texts()
        got = {r.doc_id: r.class_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        assert got == self.brute(rows)

    def test_pairs_within_a_large_bucket_of_other_classes(self, spark):
        from vigilia.llm.neardup import near_duplicates

        r = random.Random(3)
        own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
        template, rows = own(90), []  # 86 of 97 runs: unrelated texts have 0.796, the two of a pair 0.848
        for _ in range(150):
            shared = own(3)
            rows += [template + shared + own(8) for _ in range(2)]
        r.shuffle(rows)
        rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        want = self.brute(rows)
        assert len(set(want.values())) == 150 and got == want

    def test_copies_with_a_line_repeated(self, spark):
        from vigilia.llm.neardup import near_duplicates

        r = random.Random(8)
        own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows = []  # 60 runs in common, 14 of the second alone, 10 of these 400 times: sets at 0.811
        for _ in range(12):
            page = own(64)
            rows += [page, page + own(10) * 400]
        rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
        got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        assert got == {i: i - i % 2 for i in range(24)} == self.brute(rows)

    def test_template_texts_meet_in_few_rows(self, spark):
        """Texts of one template below the similarity: the exact join makes few of the pairs, and still all that hold."""
        from vigilia.llm import neardup as n

        r = random.Random(6)
        own = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
        template, rows = own(120), []
        for i in range(300):
            words = template[:]
            for _ in range(r.randint(1, 6)):
                words[r.randrange(120)] = own(1)[0]
            rows.append((i, " ".join(words)))
        rows = [(i, w) for i, w in rows if r.random() < 0.95]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: x.class_id for x in n.near_duplicates(frame, "doc_id", "text").collect()}
        want = self.brute(rows)
        assert got == want and 50 < len(set(want.values())) < 280
        sets = n.run_sets(frame.select(n.F.col("doc_id").alias("id")), frame.select(n.F.col("doc_id").alias("id"), "text"))
        mixed = spark.createDataFrame([(1, k, c, 300) for k, c in want.items()], "key long, id long, class long, n long")
        pairs = [tuple(x) for x in n._rest(mixed, sets, 0.8).collect()]
        assert all(want[a] != want[b] for a, b in pairs) and len(pairs) < 2000  # of some 40,000 pairs

    def test_copies_of_a_run_grow_with_its_texts(self, spark):
        """Whatever its classes, a run of many texts is copied twice at most, and all pairs across classes still meet, once each."""
        from vigilia.llm import neardup as n

        for classes in (2, 5, 600):  # of 600 texts
            rows = [(7, i, 0 if i >= classes else i, 100, 100, 1, True) for i in range(600)]
            heads = spark.createDataFrame(rows, "run long, id long, class long, n int, have long, place int, short boolean")
            dealt, copied = n._sides(heads)
            assert dealt.count() == 600 and copied.count() <= 1200
            pairs = n._met(heads, 0.8)
            assert pairs.count() == sum(a[2] != b[2] for i, a in enumerate(rows) for b in rows[:i])
        met = dealt.join(copied, ["run", "salt"]).where("x_class <> y_class AND (NOT x_other OR x_id < y_id)")
        assert met.count() == pairs.count()

    def test_keys_of_any_type_and_name(self, spark):
        from vigilia.llm.neardup import keep_one, near_duplicates

        rows = self.texts()
        want = self.brute([(f"k{i:03}", t) for i, t in rows])
        for key in ("id", "class_id", "class", "text"):
            frame = spark.createDataFrame([(f"k{i:03}", t, 0, 0) for i, t in rows], f"{key} string, body string, digest int, n int")
            if key in ("id", "class_id"):
                got = near_duplicates(frame, key, "body")
                assert {x[0]: x[1] for x in got.collect()} == want and got.columns[0] == key
            else:
                assert {x[0] for x in keep_one(frame, key, "body").collect()} == set(want.values())

    def test_sketch_estimates_probability_jaccard(self):
        from vigilia.llm.neardup import prob_minhash

        r = np.random.default_rng(5)
        x = dict(zip(r.integers(1, 1 << 60, 80).tolist(), r.uniform(1, 4, 80).tolist()))
        y = {k: v * r.uniform(0.5, 2) for k, v in list(x.items())[:60]} | dict(zip(r.integers(1, 1 << 60, 20).tolist(), r.uniform(1, 4, 20).tolist()))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        elements = np.array([*x, *y], np.uint64)
        weights = np.array([*x.values(), *y.values()])
        a, b = prob_minhash(elements, weights, np.array([0, len(x), len(x) + len(y)]), 4096)
        assert (a == b).mean() == pytest.approx(want, abs=0.04)
        assert prob_minhash(elements[:0], weights[:0], np.array([0, 0]), 8).tolist() == [[0] * 8]

    def test_components(self, spark):
        from vigilia.llm.neardup import components

        edges = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(51, 80)] + [(100, 101), (101, 100), (7, 7)]
        got = {r.id: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(21)}, **{i: 50 for i in range(50, 80)}, 100: 100, 101: 100}

    def test_keep_one_and_odd_rows(self, spark):
        from vigilia.llm.neardup import keep_one, near_duplicates

        kept = [r.doc_id for r in keep_one(odd_docs(spark), "doc_id", "text").collect()]
        assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 7, None, 9], key=str)
        assert near_duplicates(odd_docs(spark), "doc_id", "text").count() == len(ODD)
        assert near_duplicates(empty_docs(spark), "doc_id", "text").count() == 0


class TestSharding:
    def test_law_and_places(self, spark):
        from vigilia.llm.sharding import shard_records

        rows = [(i, "x" * random.Random(i).randint(0, 400)) for i in range(3000)] + [(None, "n"), (5000, None)] + [(7000, "same")] * 500
        frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int")
        got = shard_records(frame, "doc_id", "text", 40).toPandas()
        assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got.shard.between(0, 39).all()
        for _, part in got.groupby("shard"):
            assert sorted(part.slot) == list(range(len(part)))
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() - sums.min() <= 0.01 * sums.mean()
        want = sorted((-1 if k is None else k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
        assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want

    def test_rebalancing_moves_little(self):
        from vigilia.llm.sharding import rebalance

        r = random.Random(1)
        sizes = {s: r.randint(50, 150) for s in range(4000)}
        first = rebalance(sizes, {s: s % 40 for s in range(4000)}, 40)
        again = rebalance(sizes, first, 40)
        assert first == again
        grown = rebalance(sizes, first, 41)
        moved = sum(first[s] != grown[s] for s in sizes)
        assert moved < 4000 / 41 * 2 and max(grown.values()) == 40
        shrunk = rebalance(sizes, first, 39)
        assert set(shrunk.values()) == set(range(39))

    def test_versions(self, spark):
        from vigilia.llm.common import shared_dir
        from vigilia.llm.sharding import SlotMap, shard_records

        path = shared_dir(spark)
        assert shard_records(odd_docs(spark), "doc_id", "text", 3, slots=64, path=path).count() == len(ODD)
        store = SlotMap(spark, path)
        assert store.read(0).count() == store.read().count() == 64 and store.versions() == [0, 1]
        assert shard_records(empty_docs(spark), "doc_id", "text", 3).count() == 0


    def test_a_second_call_edits_the_newest_map(self, spark):
        from vigilia.llm.common import shared_dir
        from vigilia.llm.sharding import SlotMap, shard_records

        path, r = shared_dir(spark), random.Random(2)
        docs = spark.createDataFrame([(str(i), "x" * r.randint(0, 300), i, i) for i in range(2000)], "k string, text string, shard int, size int")
        more = docs.unionByName(spark.createDataFrame([(f"n{i}", "y" * 200, i, i) for i in range(300)], docs.schema))
        first = {x.virtual_slot: x.shard for x in shard_records(docs, "k", "text", 5, slots=256, path=path).collect()}
        again = shard_records(more, "k", "text", 5, slots=256, path=path).toPandas()
        store = SlotMap(spark, path)
        assert store.versions() == [0, 1, 2] and len(again) == 2300
        one, two = ({x.virtual_slot: x.shard for x in store.read(v).collect()} for v in (1, 2))
        assert all(one[s] == shard for s, shard in first.items()) and 0 < sum(one[s] != two[s] for s in one) < 100
        assert all(two[s] == shard for s, shard in zip(again.virtual_slot, again.shard))
        sums = again.groupby("shard")["size"].sum()
        assert sums.max() - sums.min() <= 0.02 * sums.mean()
        with pytest.raises(ValueError):
            shard_records(docs, "k", "text", 5, slots=128, path=path)
        with pytest.raises(Exception, match="exists"):
            store.write(2, two)


class TestQueriesAndPipeline:
    def test_names_and_schemas(self, spark):
        import __spark_entry__ as entry

        got = entry.queries()
        for n in range(1, 11):
            assert sum(k.startswith(f"op{n}_") for k in got) == 1
        assert "pipeline" in got

    def test_stages(self, spark):
        import corpus_pipeline as c

        docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, F.lit("12 34")).otherwise(F.col("text")))
        sizes = [docs.count()]
        for name, stage in c.STAGES:
            out = c.cut(stage(spark, docs, SF))
            if name != "packing":
                assert out.columns == docs.columns
                assert out.exceptAll(docs).isEmpty()
            docs, sizes = out, [*sizes, out.count()]
        assert sizes[1] == sizes[0] - 1 and sizes[2] >= sizes[3] >= sizes[4] > 0.5 * sizes[0]
        assert [n for n, _ in c.STAGES] == ["language ID", "toxicity", "near dedup", "decontamination", "packing"]

    def test_odd_documents(self, spark):
        import corpus_pipeline as c

        docs = spark.createDataFrame([(k, t, None, "s", None) for k, t in ODD], DOC)
        for name, stage in c.STAGES:
            out = stage(spark, docs, SF)
            if name == "packing":
                assert out.groupBy().agg(F.sum("length")).first()[0] >= len(ODD)
            else:
                assert out.columns == docs.columns and out.count() <= len(ODD)
            if name not in ("packing", "language ID"):  # toxicity, near dedup and decontamination leave null keys and null texts
                assert {(r.doc_id, r.text) for r in out.collect()} >= {(None, "no key"), (1, None), (2, "")}

    def test_empty_table_and_clashing_names(self, spark):
        import corpus_pipeline as c

        extra = ["score", "lang_pred", "predicted", "Score_", "id", "class", "class_id", "digest", "_text", "_key", "start", "length", "item_id", "k", "n", "words", "h", "bands", "runs", "key"]
        docs = spark.createDataFrame([(k, t, None, "s", None) for k, t in ODD], DOC).select("*", *(F.lit(i).alias(n) for i, n in enumerate(extra)))
        for name, stage in c.STAGES:
            out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
            assert none.count() == 0
            if name != "packing":
                assert out.columns == none.columns == docs.columns
                assert all(r[n] == i for r in out.collect() for i, n in enumerate(extra))
            else:
                assert out.count() >= len(ODD)
