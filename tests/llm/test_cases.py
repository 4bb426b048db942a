"""Cases that a method has to get right beside the brute-force comparisons: hot keys cut small, clashing columns, repeated ids, other partitions, held-out rows."""

import collections
import itertools
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat_format, common, decontaminate, elias_fano, hmm_scores, kernels, license_scan, near_dedup, quality_classifier, quality_rules, secrets, sentencepiece_scan, token_output

SF = "/root/testdata/sf0.01"


def sentences(n, seed=0):
    return " ".join(f"w{(j * 31 + seed * 17) % 9973}" for j in range(n))


def test_long_patterned_words_have_their_own_hashes():
    word = lambda a, b: "".join("ab"[bin(i).count("1") % 2 == b] if a else "" for i in range(4096)).encode()
    texts = [word(1, 0), word(1, 1), word(1, 0).upper()]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    h = kernels.Hasher("space", lower=True).words(data, offsets)[2]
    assert len(h) == 3 and h[0] != h[1] and h[0] == h[2]


def components_by_brute_force(rows):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append((doc_id, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    return {i: min(d for k, (d, _) in enumerate(sets) if find(k) == find(i)) for i in range(len(sets))}


def test_hot_keys_in_small_tiles_and_copies_of_blocks(spark, monkeypatch):
    """A large group of near copies, outsiders that share keys with it, and a second group, with limits that cut all of them."""
    base, other = sentences(150).split(), sentences(150, 5).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[(i * 7) % 150] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(12):  # alike in a half only
        rows.append((100 + i, " ".join(base[:90] + [f"y{i}_{j}" for j in range(60)])))
    for i in range(30):
        w = list(other)
        w[(i * 5) % 150] = f"z{i}"
        rows.append((200 + i, " ".join(w)))
    for name, value in (("TILE", 6), ("ASKERS", 3), ("BLOCK_ROWS", 8)):
        monkeypatch.setattr(near_dedup, name, value)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = components_by_brute_force(rows)
    assert got == {d: want[i] for i, (d, _) in enumerate(rows)}


def test_deduplication_tells_rows_apart_by_text(spark):
    a, b = sentences(60), sentences(60, 9)
    rows = [(1, a, "k"), (1, b, "l"), (1, a, "m"), (2, a, "n"), (None, a + " more", "o"), (None, sentences(50, 3), "p"), (None, sentences(50, 3), "q"), (3, None, "r"), (3, None, "s"), (4, "", "t"), (5, "", "u")]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    left = near_dedup.deduplicated(table)
    assert left.columns == table.columns
    got = sorted((str(r.doc_id), r.text or "", r.digest) for r in left.collect())
    assert [x[:2] for x in got] == sorted([("1", a), ("1", b), ("None", sentences(50, 3)), ("3", ""), ("4", ""), ("5", "")])
    assert near_dedup.deduplicated(table.limit(0)).count() == 0


def test_scratch_tables_go(spark):
    folder = common.scratch(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    near_dedup.deduplicated(spark.createDataFrame([(i, sentences(40, i % 3)) for i in range(9)], "doc_id long, text string")).count()
    decontaminate.decontaminated(spark.createDataFrame([(1, sentences(40))], "doc_id long, text string"), spark.createDataFrame([(1, sentences(20))], "item_id long, text string")).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"components", "gone", "repeated", "contaminated"}


def test_redaction_keeps_columns(spark):
    rows = [(1, None, 7, "a", "b", "c", "d", "e"), (2, "", 0, None, "b", "c", "d", "e"), (3, "token=abcdefgh end 🙂 secret: qwertyuiop", 1, "a", "b", "c", "d", "e"), (3, "plain", 5, "a", "b", "c", "d", "e"), (None, "AKIA" + "Z" * 16, 2, "a", "b", "c", "d", "e")]
    table = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, `of` string, of_kinds string, found string, clean string, row string")
    got = secrets.redact(table)
    assert got.schema == table.schema
    want = [(1, None, 7), (2, "", 0), (3, "[assign] end 🙂 [assign]", 23), (3, "plain", 5), (None, "[access]", 8)]
    assert sorted(((str(r.doc_id), r.text or "", r.n_chars) for r in got.collect())) == sorted((str(a), b or "", c) for a, b, c in want)
    assert all((r["of_kinds"], r.found, r.clean, r.row) == ("b", "c", "d", "e") for r in got.collect())
    assert secrets.redact(table.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    n = 3 * secrets.TOGETHER + 5
    found = secrets.secret_spans(spark.createDataFrame([(1, "token=abcdefgh " * n)], "doc_id long, text string")).first().found
    assert [(x.start, x.end) for x in found] == [(15 * i, 15 * i + 14) for i in range(n)]


def test_blocks_of_windows(spark, monkeypatch):
    """The same verdicts whether the benchmark is one block or many."""
    docs = spark.createDataFrame([(i, sentences(300, i % 4) + (" end" if i % 2 else "")) for i in range(12)] + [(50, None), (None, sentences(40, 2)), (0, "quite another text")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(sentences(300, i).split()[10 * i : 10 * i + 30])) for i in range(4)] + [(9, "one two"), (10, None)], "item_id long, text string")
    rows = lambda: sorted(map(str, decontaminate.contamination(docs, items).select("doc_id", "digest", "n_words", "n_hit", "items", "near_items", "contaminated").collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    assert rows() == whole and any("contaminated=True" in r for r in whole)


def test_decontamination_tells_rows_apart_by_text(spark):
    bad, clean = sentences(30), sentences(30, 8)
    table = spark.createDataFrame([(1, bad, 1), (1, clean, 2), (None, bad, 3), (None, clean, 4), (None, None, 5)], "doc_id long, text string, terms int")
    items = spark.createDataFrame([(7, bad)], "item_id long, text string")
    left = decontaminate.decontaminated(table, items)
    assert left.columns == table.columns and sorted(r.terms for r in left.collect()) == [2, 4, 5]
    assert decontaminate.decontaminated(table.limit(0), items).count() == 0 and decontaminate.decontaminated(table, items.limit(0)).count() == 5


def test_cascade_leaves_rejected_texts_out(spark):
    texts = ["few words", sentences(40), sentences(40).upper(), "### $$$ " * 30 + sentences(30), "\n".join([sentences(9)] * 8), "", None] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data, offsets = kernels.column(__import__("pyarrow").array([t or "" for t in texts]))
    stats = lambda: quality_rules.Stats(data, offsets, quality_rules._hashers())
    want = np.ones(len(texts), dtype=bool)
    for rule in quality_rules.RULES:
        want &= ~rule.rejects(stats())
    for order in itertools.islice(itertools.permutations(quality_rules.RULES), 0, 720, 97):
        kept, asked = quality_rules.cascade(order, stats())
        assert (kept == want).all()
        alive = np.ones(len(texts), dtype=bool)
        for rule, n in zip(order, asked.tolist(), strict=True):
            assert n == alive.sum()
            alive &= ~rule.rejects(stats())
    report = quality_rules.cascade_report(docs, quality_rules.RULES).orderBy("place").collect()
    assert report[0].asked == len(texts) and report[-1].asked < len(texts) and sum(r.rejected for r in report) == (~want).sum()
    assert len(quality_rules.measured_order(docs, sample_rows=30)) == len(quality_rules.RULES)


def test_select_agrees_with_all_numbers():
    r = np.random.default_rng(2)
    for n in (1, 255, 256, 257, 5000):
        values = np.sort(r.integers(0, 10**7, n))
        coded = elias_fano.EliasFano(elias_fano.encode(values.astype(np.uint64)))
        assert [coded.select(i) for i in range(n)] == values.tolist()


def test_token_shards_of_repeated_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    table = spark.createDataFrame([(None, f"row {i}") for i in range(50)] + [(7, f"other {i}") for i in range(50)], "doc_id long, text string").repartition(6)
    got = token_output.token_output(table, path).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 50 + [7] * 50
    with pytest.raises(ValueError, match="other ways"):
        token_output.shards(table, public_tokenizers.path("byte_bpe_50k.json"))


def test_library_ids_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    more = [(10**6, None), (10**6 + 1, "x" * 3000), (10**6 + 2, "  two  blanks ▁ \n\t é日本語🙂"), (10**6 + 3, "")]
    table = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: np.frombuffer(r.library_ids, dtype="<u4").tolist() for r in sentencepiece_scan.library_ids(table, path).collect()}
    for r in table.collect():
        assert got[r.doc_id] == library.encode(r.text or ""), r.doc_id
    for chunk in (sentencepiece_scan.CHUNK, 100, 17):
        digest = {r.doc_id: r for r in sentencepiece_scan.sentencepiece_digest(table if chunk > 1000 else table.where("length(text) < 4000"), path, chunk).collect()}
        assert digest and all(r.round_trip and r.library_tokens == len(got[k]) and r.library_crc32 == zlib.crc32(np.array(got[k], dtype="<u4").tobytes()) for k, r in digest.items()), chunk


def test_fractional_scores():
    """Log probabilities that differ by less than 1 decide, as in the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(np.log2(i + 2)) * 0.371
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = sentencepiece_scan.Pieces([(p.piece, p.score, p.type) for p in model.pieces])
    exact = {p.piece: p.score for p in model.pieces}
    whole = collections.Counter()
    for i in range(60):
        text = " ".join(("the", "house", "stands", "among", "trees", "near", "water")[(i * k) % 7] + "ing"[: (i + k) % 4] for k in range(1, 12))
        ids = pieces.best(sentencepiece_scan.escape(" " + text))[1]
        score = lambda x: sum(exact[model.pieces[k].piece] for k in x)
        assert abs(score(ids) - score(library.encode(text))) < 1e-3
        whole[ids == library.encode(text)] += 1
    assert whole[True] > 50


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    runs = [{r.doc_id: r for r in hmm_scores.lm_scores(docs.repartition(n, F.xxhash64("doc_id")), passes=6).collect()} for n in (1, 5, 9)]
    for other in runs[1:]:
        assert other.keys() == runs[0].keys()
        assert all(abs(r.score - runs[0][k].score) <= 1e-6 * abs(r.score) and r.base_score == pytest.approx(runs[0][k].base_score, abs=1e-6) for k, r in other.items())


def test_held_out_texts_score_better_than_by_counts(spark):
    rows = hmm_scores.lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows.s / rows.n > rows.b / rows.n + 0.15


def test_classes_share_their_probability(spark):
    """Over all words of the training texts and the end, emissions times shares in classes sum to 1 at most in each state."""
    known = hmm_scores.Vocabulary(100, 5, 10, np.array([3, 9], dtype=np.uint64), np.array([40, 20]), np.zeros(hmm_scores.HASHED), np.zeros(hmm_scores.HASHED))
    assert abs(known.share().sum() - 1) < 1e-9
    model = hmm_scores.Hmm.first(known.share())
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_normal_equations_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x = quality_classifier.described(docs)
    model = quality_classifier.fit(common.written(x, "described"), labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(np.frombuffer(r.x, dtype=float), quality[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 5) for r in x.collect() if r.doc_id in quality]
    learn = [(a, y) for a, y, fold in rows if fold not in (0, 1)]
    a, y = np.stack([v for v, _ in learn]), np.array([v for _, v in learn], dtype=float)
    assert np.allclose(model.mean, a.mean(axis=0)) and np.allclose(model.scale, np.sqrt(np.maximum(a.var(axis=0), 1e-6)), rtol=1e-6)
    z = model.fourier(a)
    weights = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * np.sqrt(len(a)) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ weights, z @ model.weights, atol=1e-6)
    assert (np.diff(model.values) >= 0).all()


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = quality_classifier.quality_scores(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    n = {(r.quality, r.predicted): r["count"] for r in found.groupBy("quality", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.98 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.9


def test_acceptance_keeps_columns(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"x": F.lit(1), "place": F.lit("p"), "quality": F.lit(2)})
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    left = quality_classifier.accepted(docs, labels)
    assert left.schema == docs.schema and 0 < left.count() < docs.count() and left.where("x <> 1 or place <> 'p' or quality <> 2").count() == 0
    by_scores = quality_classifier.quality_scores(docs, labels).where("predicted = 1").count()
    assert left.count() == by_scores
    assert quality_classifier.accepted(docs.limit(0), labels).count() == 0 and quality_classifier.accepted(docs, labels.limit(0)).count() == docs.count()


def lowered(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def licenses_by_brute_force(text):
    """Every sentence cut in the three ways, and every rule at every sentence."""
    known = {}
    for name, said in license_scan.ALL_SENTENCES.items():
        known.setdefault(tuple(words_of(said)), name)
    rules, text = sorted(license_scan.RULES, key=lambda r: -len(r[1])), lowered(text)
    tokens = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))
    found = set()
    for feeds, colon in ((1, False), (2, False), (99, True)):
        start = 0
        for i, m in enumerate(tokens):
            gap = text[m.end() : tokens[i + 1].start()] if i + 1 < len(tokens) else None
            if gap is None or re.search(r"[.!?][ \t-\r]", gap) or gap.count("\n") >= feeds or colon and re.search(r":[ \t-\r]", gap):
                name = known.get(tuple(t.group() for t in tokens[start : i + 1]))
                if name:
                    found.add((start, i + 1, name))
                start = i + 1
    rows, used, out = sorted(found), set(), []
    for i, row in enumerate(rows):
        if i in used:
            continue
        for licence, names in rules:
            if names[0] != row[2]:
                continue
            chain = [i]
            for name in names[1:]:
                last = rows[chain[-1]][1]
                j = next((k for k in range(chain[-1] + 1, len(rows)) if last <= rows[k][0] <= last + license_scan.MOST_BETWEEN and rows[k][2] == name and k not in used), None)
                if j is None:
                    break
                chain.append(j)
            if len(chain) == len(names):
                used.update(chain)
                out.append(licence)
                break
    return out


def licence_texts():
    s = license_scan.SENTENCES
    texts = {}
    for licence, names in license_scan.TEXT_RULES:
        texts.setdefault(licence, []).append(". ".join(s[n].rstrip(":") + (":" if s[n].endswith(":") else "") for n in names).replace(":.", ":") + ".")
    return [(licence, t) for licence, all_of in texts.items() for t in all_of]


def variants(text):
    lines = re.sub(r"(.{50,70}) ", r"\1\n", text)
    return {"plain": text, "wrapped": lines, "hash": "\n".join("# " + x for x in lines.split("\n")), "stars": "/*\n" + "\n".join(" * " + x for x in lines.split("\n")) + "\n */", "upper": lines.upper(), "inside": "Some code here.\n\n" + lines + "\n\nint main() {}"}


def test_licences_by_brute_force(spark):
    rows, want = [], []
    for licence, text in licence_texts():
        for kind, t in variants(text).items():
            rows.append((len(rows), t))
            want.append((licence, kind))
    notices = [f"{n} {a}{name}." for names in license_scan.NAMES.values() for name in names for n, a in (("Released under", "the "), ("This project is licensed under", "a "))]
    rows += [(len(rows) + i, t) for i, t in enumerate([*notices, *(f"// SPDX-License-Identifier: {x}\n#include <a.h>" for x in license_scan.NAMES), "MIT is a school. The licence is nice.", ""])]
    got = {r.doc_id: [x.license for x in r.found] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == licenses_by_brute_force(t), t
    hit = [licence in got[i] for i, (licence, _) in enumerate(want)]
    assert sum(hit) / len(hit) >= 0.9, [w for w, h in zip(want, hit, strict=True) if not h]
    assert all(got[len(want) + i] for i in range(len(notices) + len(license_scan.NAMES))) and got[len(rows) - 1] == got[len(rows) - 2] == []


def test_repeated_notices_take_time_in_proportion(spark):
    text = (license_scan.SENTENCES["mit-grant"] + "\n\n") * 2000
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_sentences == 2000 and row.found == []


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_whole_public_texts(spark):
    texts = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    rows = [(name, open(f"/usr/share/common-licenses/{name}", encoding="utf-8", errors="replace").read()) for name in texts if os.path.exists(f"/usr/share/common-licenses/{name}")]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {x.license for x in r.found} for r in license_scan.license_scan(table).collect()}
    assert sum(texts[name] in got[i] for i, (name, _) in enumerate(rows)) >= 0.9 * len(rows)


def test_turns_without_words_fill_windows(spark):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "") for i in range(3000)], "conv_id long, turn long, role string, text string")
    found = chat_format.windows(rows, budget=100, history_tokens=20)
    assert found.agg(F.max("n_new")).first()[0] <= 100 and chat_format.read_back(found).first().n_turns == 3000


def test_conversations_with_further_columns(spark):
    rows = [(1, 1, "system", "Be kind.", 5, "x"), (1, 2, "user", "hello there", 6, "y"), (1, 3, "assistant", "good day " * 400, 7, "z"), (None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens int, slot string")
    plain = table.select("conv_id", "turn", "role", "text")
    found = lambda t: sorted(map(str, chat_format.read_back(chat_format.windows(t)).collect()))
    assert found(table) == found(plain) and len(found(table)) == 2
