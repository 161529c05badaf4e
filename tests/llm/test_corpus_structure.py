"""Token alignment, repeated byte strings and the prefix trie, each against brute force."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


class TestAlignment:
    A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
    ODD = [
        (-1, None), (-2, ""), (-3, " "), (-4, "a▁b c"), (-5, "  two  spaces \n x"), (-6, "<|endoftext|> </s> x<|endoftext|>y <s>"), (-7, "é 漢字 😀 z　 y \xa0 q"),
        (-8, "tab\t x \r\n y"), (-9, "it's 12 we'll  "), (-10, "\n\n a"), (-11, "a \x00 b"), (-12, "▁"), (None, "no key here"), (5, "twice the same"), (5, "twice the same"), (6, "word " * 3000), (7, "long" * 5000),
    ]

    @staticmethod
    def brute(rows):
        """Whole texts by both libraries, cut at the common ends one by one."""
        import public_tokenizers as P
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(P.path(TestAlignment.A)), sentencepiece.SentencePieceProcessor(model_file=P.path(TestAlignment.B))
        a.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
        found, docs = [], collections.Counter()
        for key, text in rows:
            ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
            bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            whole = (" " + text).encode() if text else b""
            if not b"".join(bytes_a) == whole == b"".join(bytes_b):
                ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
            groups, i, at_a, at_b = [([], [])], 0, 0, 0
            j = 0
            while i < len(ids_a) or j < len(ids_b):
                if at_a <= at_b and i < len(ids_a):
                    groups[-1][0].append(ids_a[i])
                    at_a += len(bytes_a[i])
                    i += 1
                else:
                    groups[-1][1].append(ids_b[j])
                    at_b += len(bytes_b[j])
                    j += 1
                if at_a == at_b:
                    groups.append(([], []))
            groups.pop()
            links = [(x, y) for p, q in groups for x in p for y in q]
            docs.update(set(links))
            found.append((key, ids_a, ids_b, groups, links))
        best = collections.defaultdict(int)
        for (x, _), n in docs.items():
            best[x] = max(best[x], n)
        out = []
        for key, ids_a, ids_b, groups, links in found:
            shown = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
            out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if ids_a else ""))
        return sorted(out, key=str)

    def align(self, docs, **more):
        import public_tokenizers as P

        from vigilia.llm.alignment import align_corpus

        return align_corpus(docs, "doc_id", "text", P.path(self.A), P.path(self.B), **more)

    def test_whole_texts_equal_brute_force(self, spark):
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        rows = [tuple(r) for r in docs.limit(60).collect()] + self.ODD
        want = self.brute(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
        assert rows_of(self.align(frame)) == want
        assert rows_of(self.align(frame.repartition(3), part_pairs=500, memo_units=50)) == want  # many parts, a memo that is emptied again and again

    def test_empty_table(self, spark):
        assert self.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0

    def test_diagonal_groups(self):
        import numpy as np

        from vigilia.llm.alignment import diagonal_groups

        r = random.Random(3)
        for _ in range(300):
            n = r.choice([1, 3, 20, 400])
            a, b = (sorted({*r.sample(range(1, 2 * n), r.randint(0, n)), 2 * n}) for _ in range(2))
            if r.random() < 0.5:  # long one-to-one stretches
                b = sorted({*a} ^ {*r.sample(range(1, 2 * n), min(n, 3))} | {2 * n})
            common = sorted({*a} & {*b})
            x, y = diagonal_groups(np.array(a), np.array(b))
            assert [a[i - 1] for i in x] == common == [b[i - 1] for i in y]

    def test_query_reads_all_documents(self, spark):
        from vigilia.llm.queries import queries

        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert rows_of(queries()["op11_token_alignment"](spark, SF)) == self.brute([(r.doc_id, r.text) for r in docs.collect()])


class TestSuffixes:
    @staticmethod
    def brute(rows, length):
        texts, windows = [(k, (t or "").encode()) for k, t in rows], collections.Counter()
        for _, raw in texts:
            windows.update(raw[p : p + length] for p in range(len(raw) - length + 1))
        out = []
        for key, raw in texts:
            gone = bytearray(len(raw))
            for p in range(len(raw) - length + 1):
                if windows[raw[p : p + length]] > 1:
                    gone[p : p + length] = b"\1" * length
            left = bytes(x for x, y in zip(raw, gone) if not y)
            out.append((key, len(raw), sum(gone), sum(1 for i, y in enumerate(gone) if y and not (i and gone[i - 1])), hashlib.sha256(left).hexdigest()))
        return sorted(out, key=str)

    @staticmethod
    def pieces(seed, length):
        """Texts of overlapping cuts of one base string between noise, so that repeats begin and end at every offset."""
        r = random.Random(seed)
        base, rows = "".join(r.choice("ab") for _ in range(2000)), []
        for i in range(100):
            text = "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60)))
            for _ in range(r.randint(0, 4)):
                at = r.randint(0, 1900)
                text += base[at : at + r.randint(1, 2 * length)] + "".join(r.choice("cdefgh") for _ in range(r.randint(0, 20)))
            rows.append((i, text))
        return [*rows, *rows[:10], (200, rows[5][1] + "z"), (201, "a" * 100), (None, rows[7][1]), *((300 + i, rows[7][1]) for i in range(5)), (400, None), (401, ""), (402, "é" * 100)]

    @pytest.mark.parametrize("length", [2, 12, 40, 200])
    def test_equals_brute_force(self, spark, length):
        from vigilia.llm.suffixes import drop_repeats

        rows = self.pieces(length, length)
        got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(1)), "doc_id", "text", length)
        assert rows_of(got) == self.brute(rows, length)

    def test_query_equals_brute_force_on_whole_documents(self, spark):
        from vigilia.llm.queries import queries

        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
        want = self.brute([tuple(r) for r in docs.collect()], 200)
        assert rows_of(queries()["op12_suffix_dedup"](spark, SF)) == want and sum(r[2] for r in want) > 0

    def test_long_runs_of_one_byte_and_blocks(self, spark, monkeypatch):
        import numpy as np

        from vigilia.llm import suffixes

        r = random.Random(5)
        raw = "".join(r.choice("abc") for _ in range(6000)).encode()
        data, at = np.frombuffer(raw, np.uint8), np.array([0, 2500, 2500, 6000])
        whole = suffixes.anchors(data, at, 200)
        monkeypatch.setattr(suffixes, "BLOCK", 97)
        cut = suffixes.anchors(data, at, 200)
        assert all((whole[k] == cut[k]).all() for k in whole)
        starts = sum((whole["high"] - whole["low"] + 1).tolist())
        assert starts == 2500 - 199 + 3500 - 199  # each window has one anchor
        rows = [(1, "a" * 3000), (2, "ab" * 500 + "c"), (3, "x" * 199), (4, "x" * 200)]
        assert rows_of(suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")) == self.brute(rows, 200)

    def test_kept_bytes_and_empty_table(self, spark):
        from vigilia.llm.suffixes import drop_repeats

        rows = [(1, "p" * 5 + "q" * 12 + "one"), (2, "r" + "q" * 12 + "two")]
        got = {r.doc_id: bytes(r.kept) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 12, kept=True).collect()}
        assert got == {1: b"pppppone", 2: b"rtwo"}
        assert drop_repeats(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


class TestPrefixTrie:
    @staticmethod
    def brute(rows):
        convs = collections.defaultdict(list)
        for conv, turn, role, text in rows:
            if conv is not None:
                role, text = role or "", text or ""
                convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
        said = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
        members, last = collections.defaultdict(list), {}
        for c, own in said.items():
            h = zlib.crc32(str(c).encode()) % 4
            path = tuple(said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])  # % as in SQL, towards 0
            last[c] = path
            for d in range(len(path) + 1):
                members[path[:d]].append(c)
        import re

        children, saved, leaves = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
        for path, ms in members.items():
            own = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
            for d in range(len(path) + 1):
                saved[path[:d]] += own
                leaves[path[:d]] += not children[path]
        out = []
        for path, ms in members.items():
            ends = ",".join(str(c) for c in sorted(ms) if last[c] == path)
            out.append((min(ms), len(path), min(members[path[:-1]]) if path else None, len(ms), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
        return sorted(out, key=str)

    @staticmethod
    def talks(seed, n=120, deepest=40):
        r, rows = random.Random(seed), []
        for c in range(n):
            for t in range(r.choice([0, 1, 2, 3, 8, r.randint(0, deepest)])):
                rows.append((c, r.choice([t, None]) if r.random() < 0.05 else t, r.choice(["user", "bot", None]) if r.random() < 0.1 else "user", r.choice(["a", "a b", "", None]) if r.random() < 0.2 else "same  words here"))
        rows += [(None, 1, "user", "no conversation"), (-40, 1, "user", "x"), (-45, 1, "user", "y"), (10**15, 0, "user", "far"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "bot", "tie")]
        return rows

    @pytest.mark.parametrize("band", [2, 3, 8])
    def test_equals_brute_force(self, spark, band):
        from vigilia.llm.prefix_trie import prefix_trie

        rows = self.talks(band)
        frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("depth", F.lit(1)).repartition(5)
        assert rows_of(prefix_trie(frame, band=band)) == self.brute(rows)

    def test_one_conversation_holds_most_rows(self, spark):
        """One deep conversation in several stretches, copies of another, and an empty table."""
        from vigilia.llm.prefix_trie import prefix_trie

        rows = [(3, t, "user", f"word {t % 7}") for t in range(700)] + [(c, t, "user", f"word {t % 7}") for c in range(40, 70) for t in range(6)]
        frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
        assert rows_of(prefix_trie(frame)) == self.brute(rows)
        assert prefix_trie(frame.limit(0)).count() == 0

    def test_query_equals_brute_force_and_its_sql(self, spark):
        import duckdb

        from vigilia.llm.queries import oracle_sql, queries

        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = rows_of(queries()["op13_prefix_trie"](spark, SF))
        assert got == self.brute(rows)
        with duckdb.connect() as base:
            base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
            assert sorted(base.sql(oracle_sql()["op13_prefix_trie"]).fetchall(), key=str) == got
