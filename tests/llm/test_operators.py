"""Operators on training text against plain versions, and their edge cases, on a small corpus."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from screenwright.llm import (decontamination, mixing, pii, quality, scoring, secrets, simhash, substrings, tokens, wrappers)
from screenwright.llm.common import keep, look_up, shared_dir
from screenwright.llm.spans import before

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def same(got, want: list[tuple], columns: list[str]) -> None:
    have = Counter(tuple(r[c] for c in columns) for r in got.collect())
    assert have == Counter(want), list((have - Counter(want)).items())[:3] + list((Counter(want) - have).items())[:3]


def test_decontamination(spark, docs, rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for i, t in items:
        w = split(t)
        windows |= {(str(i) if i is not None else "", tuple(w[k:k + 13])) for k in range(max(1, len(w) - 12)) if w}
    want = []
    for r in rows:
        w, hit, own = split(r[1]), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    own.add(i)
        want.append((r[0], len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same(decontamination.digest(docs, bench), want, columns)
    # The same in several item blocks.
    found = decontamination.decontaminate(docs.drop("n_words"), bench, block_chars=200)
    same(found.select("doc_id", "_found.n_words", "_found.n_hit", F.size("_found.items").alias("n_items")),
         [x[:4] for x in want], columns[:4])
    none = decontamination.digest(docs, bench.limit(0))
    assert none.where("n_hit > 0 OR contaminated").count() == 0 and none.count() == len(rows)


def spans_of(text: str, shapes: list) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p, good in shapes for m in re.finditer(p, text or "") if good(m)]


def joined(spans: list[tuple], kinds: list[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def test_secrets(docs, rows):
    shapes = [("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
              ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    want = []
    for r in rows:
        s = spans_of(r[1], shapes)
        c = Counter(x[0] for x in s)
        want.append((r[0], c["assign"], c["access"], c["hex"], sha(joined(s, secrets.KINDS))))
    got = secrets.digest(docs)
    same(got, want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    assert secrets.digest(docs.limit(0)).count() == 0
    clash = secrets.with_secrets(docs.withColumnsRenamed({"n_words": "_hex", "lang": "_text", "source": "_letters"}))
    assert {r["_hex"] for r in clash.collect()} == {"x", None} and clash.columns[-1] == "_found"


def test_secrets_report_few_names(spark):
    """Among paths, hyphenated and camel-case names, at most a tenth of the reports are false; recall by length."""
    rnd = random.Random(7)
    words_ = ("config handler user profile service account request response storage network client session message parser "
              "builder factory module package version update release backup monitor report summary engine table index query").split()
    letters = secrets.ALPHABETS["base64"]
    name = lambda: rnd.choice([
        lambda: "/".join(rnd.choices(words_, k=4)) + f"/v{rnd.randint(1, 99)}",
        lambda: "-".join(rnd.choices(words_, k=4)) + f"-{rnd.randint(1, 9999)}",
        lambda: rnd.choice(words_) + "".join(w.title() for w in rnd.choices(words_, k=3)) + str(rnd.randint(1, 999))])()
    given = [("name", 0, name()) for _ in range(2200)]
    for n in (24, 32, 40, 64):
        given += [("key", n, "k1" + "".join(rnd.choices(letters, k=n - 2))) for _ in range(60)]
    frame = spark.createDataFrame([(k, n, f"the value of {x} is in use by some of the other parts here") for k, n, x in given], "kind string, n int, text string")
    got = secrets.with_secrets(frame.repartition(4)).select("kind", "n", F.size("_found.random").alias("hits")).collect()
    hits = Counter((r["kind"], r["n"]) for r in got if r["hits"])
    found = sum(v for (k, _), v in hits.items() if k == "key")
    assert hits["name", 0] <= 0.1 * (hits["name", 0] + found), hits
    assert hits["key", 64] >= 57 and hits["key", 40] >= 40 and hits["key", 32] >= 30, hits


def test_spans_of_long_texts(spark):
    """Megabytes full of matches take time by their length; patterns are not run within the lambdas of other steps."""
    n = 40_000
    texts = [" ".join(f"10.{i % 256}.{i // 256}.7 x" for i in range(n)), " ".join(f"deadbeef{i:012x} k9{i:020d}Zq" for i in range(n // 2))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    begun = time.time()
    found = {r["doc_id"]: r for r in pii.digest(frame).collect()}
    assert found[0]["n_ip"] == n
    found = {r["doc_id"]: r for r in secrets.digest(frame).collect()}
    assert found[1]["n_hex"] == n // 2 * 2
    assert pii.redact(frame).where("doc_id = 0").first()["text"] == " ".join(["[IP] x"] * n)
    assert time.time() - begun < 90
    marked = frame.selectExpr("struct(doc_id) AS _row", "text AS _text")
    for line in pii.candidates(pii.base_spans(marked))._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert not re.search(r"exists\(", line) and line.count("regexp_extract_all") <= 11


def test_running_totals(spark):
    for n in (0, 1, 63, 64, 65, 200):
        v = [(i * 37) % 11 - 5 for i in range(n)]
        frame = spark.createDataFrame([(v,)], "v array<int>")
        got = frame.select(F.expr(before("v", "s + x", 0)), F.expr(before("v", "greatest(s, x)", -9))).first()
        assert got[0] == [sum(v[:i]) for i in range(n)] and got[1] == [max([-9, *v[:i]]) for i in range(n)]


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d >= "5") for i, d in enumerate(reversed(digits))) % 10 == 0


def test_personal_data(docs, rows):
    digits = lambda m: re.sub(r"\D", "", m[0])
    shapes = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
              ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
              ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
              ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    want = []
    for r in rows:
        s = [x for x in spans_of((r[1] or "").replace("a" * 30_000, ""), shapes)]
        c = Counter(x[0] for x in s)
        want.append((r[0], c["email"], c["ip"], c["card"], c["phone"], sha(joined(s, pii.KINDS))))
    same(pii.digest(docs), want, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("doc_id IN (0, 6, 19, 21)").collect()}
    assert clean[0] is None and clean[6] == rows[6][1] and clean[21].startswith("call [PHONE] now é€ +12")
    assert "[EMAIL] or [IP] 1.2.3.999" in clean[19]
    assert pii.digest(docs.limit(0)).count() == 0
    clash = pii.redact(docs.withColumnsRenamed({"n_words": "_email", "lang": "_text", "source": "_all"}))
    assert {r["_email"] for r in clash.collect()} == {"x", None} and clash.columns[-2:] == ["_email", "_row"]


def test_labelers_find_local_numbers(spark):
    given = [(f"please call 0{i % 10}{i % 7}5-55{i % 10}-01{i % 10}{i % 3} mail a{i}@b.example.com",) for i in range(60)]
    given += [(f"version {i}234567 and order 99{i}1234567890123",) for i in range(60)]
    got = pii.with_pii(spark.createDataFrame(given, "text string")).select(
        F.startswith("text", F.lit("please")).alias("kind"), F.size("_found.number").alias("n"))
    hits = Counter((r["kind"], r["n"] > 0) for r in got.collect())
    assert hits[True, True] == 60 and hits[False, True] == 0


def test_quality(docs, rows):
    want = []
    for r in rows:
        w, t = words(r[1]), r[1] or ""
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if times[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                     len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.digest(docs)
    same(got, want, columns)
    assert got.where("base_failed AND kept").count() == 0
    assert quality.digest(docs.limit(0)).count() == 0
    assert quality.with_quality(docs).columns[:len(docs.columns)] == docs.columns


def test_quality_thresholds_follow_the_group(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * 13) % 97}x{k}" for k in range(80)), "en", f"s{i % 2}") for i in range(500)]
    junk = [(1000 + i, " ".join(f"word{k}x{i}***" for k in range(80)), "en", "s0") for i in range(20)]
    got = quality.digest(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string"))
    assert got.where("kept").count() == 500 and got.where("doc_id >= 1000 AND kept").count() == 0
    with_sketch = quality.measures(spark.createDataFrame(plain, "doc_id long, text string, lang string, source string"))
    counts = quality.sketches(with_sketch, [])
    q = {r["rate"]: r for r in quality._quantiles(counts, []).collect()}["word_length"]
    exact = sorted(len(x[1].replace(" ", "")) / 80 for x in plain)
    assert abs(q["q3"] - exact[374]) <= 0.03 * exact[374]


def test_quality_thresholds_come_from_the_tail(spark):
    """A mild outlier of an even group is out of line, the same rate is in line where the group's own tail has it; small
    groups lean on the larger one, by counts."""
    text = lambda i, n: " ".join(f"word{(i * 7 + k * 13) % 97}x{k % 10}" + "#" * (k < n) for k in range(100))
    even = [(i, text(i, 0), "en", "even") for i in range(3000)] + [(10_000, text(1, 12), "en", "even")]
    wide = [(20_000 + i, text(i, i % 13), "en", "wide") for i in range(3000)]
    tiny = [(30_000 + i, text(i, 0), "de", "tiny") for i in range(3)] + [(30_009, text(2, 70), "de", "tiny")]
    docs = spark.createDataFrame(even + wide + tiny, "doc_id long, text string, lang string, source string")
    dropped = {r["doc_id"] for r in quality.digest(docs).where("NOT kept AND NOT base_failed").collect()}
    assert dropped == {10_000, 30_009}
    of = {(r["_source"], r["rate"]): r for r in quality.group_fences(quality.measures(docs.withColumnsRenamed(
        {"lang": "_lang", "source": "_source"}))).collect()}
    assert not of["wide", "symbols"]["floor"]
    assert of["even", "symbols"]["fence"] < 0.12 < of["wide", "symbols"]["fence"] and of["tiny", "symbols"]["fence"] < 0.35


def test_repeated_passages(docs, rows):
    by_place = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})
    seen, gone = set(), {}
    for d, t in by_place:
        w = words(t)
        lost = set()
        for k in range(len(w) - 19):
            x = tuple(w[k:k + 20])
            if x in seen:
                lost |= set(range(k, k + 20))
            seen.add(x)
        gone[d, t] = (len(w), len(lost), sha(" ".join(x for k, x in enumerate(w) if k not in lost)))
    want = [(r[0], *gone[-1 if r[0] is None else r[0], r[1] or ""]) for r in rows]
    same(substrings.digest(docs), want, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert sum(x[2] for x in want) > 300
    assert substrings.digest(docs.limit(0)).count() == 0


def test_equal_hashes_are_told_apart(docs, rows, monkeypatch):
    """With a hash that is always the same, windows are still compared by their words."""
    pack = substrings._judge(20)
    found = {}
    monkeypatch.setattr(substrings, "hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    import pyarrow as pa
    import zstandard
    squeeze = zstandard.ZstdCompressor().compress
    strings = [b" ".join(b"w%d" % (k + s) for k in range(22)) for s in (0, 1)]
    places = np.array([(1, 0, 0), (2, 0, 0)], np.int64).T.tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([squeeze(places)]), pa.array([squeeze(b"\n".join(strings))])], ["a", "b", "c"])
    for out in pack(iter([batch])):
        for r in out.to_pylist():
            found[r["doc"]] = r["first"] & (2**31 - 1)
    assert found == {1: 0b111, 2: 0b100}


def test_token_counts(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows]
    same(tokens.digest(docs), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_scoring(spark, docs, rows):
    got = {r["doc_id"]: r for r in scoring.digest(docs).collect()}
    assert len(scoring.digest(docs.limit(0)).collect()) == 0
    assert got[0]["log_likelihood"] == 0 and got[0]["mean_log_likelihood"] is None and got[7]["n_words"] == 3000
    assert all(r["log_likelihood"] < 0 for r in got.values() if r["n_words"])
    # Gradients against differences.
    p = scoring.start(np.zeros(scoring.SYMBOLS))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    ids = np.random.default_rng(3).integers(1, scoring.SYMBOLS, 12)
    around, own = scoring.sides(ids, np.arange(12)), ids
    loss = lambda q: -scoring.likelihood(q, ids).mean()
    for name, at in (("embed", (int(ids[4]), 3)), ("mix", (5, 2)), ("out", (1, int(ids[0]))), ("bias", (int(ids[2]),))):
        moved = {k: v.copy() for k, v in p.items()}
        scoring.step(moved, around, own, 1.0)
        a, b = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        a[name][at] += 1e-5
        b[name][at] -= 1e-5
        assert math.isclose(p[name][at] - moved[name][at], (loss(a) - loss(b)) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


def test_scoring_prefers_the_corpus(spark):
    ordered = [(i, "the cat sat on a mat " * 40) for i in range(300)]
    docs = spark.createDataFrame([*ordered, (900, "mat a on sat cat the the on " * 30)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in scoring.digest(docs).collect()}
    assert got[5] > got[900] + 0.5


def test_scoring_trains_on_every_position(spark, docs, rows, monkeypatch):
    """Texts of any length, each of their positions once a round."""
    texts = [np.arange(1, n + 1, dtype=np.uint16) for n in [*range(30), 4000, 1]]
    met, sizes = Counter(), []

    def step(p, around, own, rate):
        sizes.append(len(own))
        met.update(zip(around[:, 1].tolist(), own.tolist(), around[:, 2].tolist(), strict=True))

    monkeypatch.setattr(scoring, "step", step)
    want = Counter((a, b, c) for t in texts for a, b, c in zip([0, *t.tolist()], t.tolist(), [*t.tolist(), 0][1:], strict=False))
    assert scoring.learn(scoring.start(np.zeros(scoring.SYMBOLS)), iter(texts)) == sum(map(len, texts)) == sum(sizes)
    assert met == want
    # The symbols that rounds read are those of every word of every row.
    coded = scoring.encoded(docs, "text", ["doc_id"], {})
    assert sum(len(r["ids"]) for r in coded.select("_code.ids").collect()) == 2 * sum(len(words(r[1])) for r in rows)


def test_scoring_gives_every_word_its_own_probability(spark, monkeypatch):
    """Among words without a symbol of their own; the part of the network is worked out again from its symbols."""
    texts = [" ".join(f"w{(k * k + i * 37) % 1500 // (1 + k % 3)}" for k in range(90)) for i in range(40)] + ["w1 rare", None, "w1"]
    counts = Counter(w for t in texts for w in words(t))
    models = []
    fit = scoring.fit
    monkeypatch.setattr(scoring, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["_found"] for r in scoring.score(docs, carry=["doc_id"]).collect()}
    top = sorted(counts, key=lambda w: (-counts[w], w))[:scoring.COMMON]
    symbol = {w: top.index(w) + 1 if w in top else scoring.COMMON + 1 + zlib.crc32(w.encode()) % scoring.SHARED for w in counts}
    assert sum(x > scoring.COMMON for x in symbol.values()) > 100
    of_class = Counter()
    for w, n in counts.items():
        of_class[symbol[w]] += n
    for i, t in enumerate(texts):
        ids = np.array([symbol[w] for w in words(t)], np.int64)
        want = scoring.likelihood(models[0], ids).sum() + sum(math.log(counts[w] / of_class[symbol[w]]) for w in words(t))
        assert got[i]["n_words"] == len(ids) and math.isclose(got[i]["log_likelihood"], want, rel_tol=1e-4, abs_tol=1e-6)
    # The chances of the words of a class add up to that of the class.
    assert all(math.isclose(sum(counts[w] / of_class[k] for w in counts if symbol[w] == k), 1) for k in of_class)


def test_near_duplicates(docs, rows):
    def fingerprint(t):
        w = words((t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {t: fingerprint(t) for t in {r[1] for r in rows}}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 4:
                x, y = root[a], root[b]
                root = {f: x if r == y else r for f, r in root.items()}
    least = {}
    for r in rows:
        if r[0] is not None:
            k = root[fps[r[1]]]
            least[k] = min(least.get(k, r[0]), r[0])
    want = [(r[0], f"{fps[r[1]]:016x}", least.get(root[fps[r[1]]])) for r in rows]
    same(simhash.digest(docs), want, ["doc_id", "fingerprint", "component_id"])
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    # One of each group; the row without an id whose text is its own stays.
    assert sorted(x for x in kept if x is not None) == sorted(set(least.values())) and kept.count(None) == 1
    assert simhash.digest(docs.limit(0)).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark, rows):
    """One id on texts of two groups loses neither; linked texts without any id leave one."""
    near, other = (rows[6][1], rows[6][1] + " end"), (rows[5][1], rows[7][1])
    frame = lambda given: spark.createDataFrame(given, "doc_id long, text string")
    linked = simhash.digest(frame([(1, near[0]), (2, near[1]), (3, other[0]), (4, other[1])])).collect()
    assert len({r["fingerprint"] for r in linked}) == 4 and sorted(r["component_id"] for r in linked) == [1, 1, 3, 4]
    kept = simhash.drop_near_duplicates(frame([(1, other[0]), (1, other[1]), (None, near[0]), (None, near[1])])).collect()
    assert {(r["doc_id"], r["text"]) for r in kept if r["doc_id"]} == {(1, other[0]), (1, other[1])}
    assert len(kept) == 3


def test_links_of_hot_keys_in_tiles(spark):
    """A dense cloud of fingerprints, in one piece and split over tiles, against all pairs."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**62, 60)}
    center = int(rng.integers(0, 2**62))
    fps |= {center ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 4), replace=False)) for _ in range(400)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
    want = Counter(Counter(root).values())
    for tile in (2048, 32):
        found = simhash.components(simhash.links(frame, tile=tile))
        sizes = Counter(r["n"] for r in found.groupBy("root").agg(F.count("*").alias("n")).collect())
        assert {k: v for k, v in sizes.items()} == {k: v for k, v in want.items() if k > 1}


def test_mixing(spark, docs, rows):
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in order if s not in free)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) if s in free else 2.0 * sizes[s] for s in order}
        above = {s for s in free if target[s] > 2 * sizes[s]}
        if not above:
            break
        free -= above
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert r["taken"] <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.digest(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.digest(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_comes_near_targets(spark):
    frame = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', CAST(id * 7919 % 300 AS INT)) AS text")
    sums = mixing.digest(frame).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 600 for r in sums)


PAGE = ('<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><div class="top"><a href="/">Home</a> menu</div>'
        '<div class="main"><h1>{0}</h1><p>One {1} &amp; more<br>line<p>Two <b>{2}</b> x<script>var a="</p>";</script></p>'
        '<div class="comments">spam {1}</div></div><form>find {2}</form><footer>&copy; us {0}</footer></body></html>')


def test_main_text(spark):
    pages = [(i, f"https://a.example/p/{i}", PAGE.format(f"Head {i}", f"alpha{i * 37}", f"beta{i * 91}")) for i in range(9)]
    odd = [(90, "https://b.example/x", "<article>Only <i>this</i></article><nav>no</nav>"), (91, None, "<p>loose"), (92, "nonsense", None),
           (93, "https://a.example/e", ""), (94, "https://c.example/", "<div>" * 3000 + "deep" + "</div>" * 3000), (95, "https://d.example", "a < b & c")]
    got = {r["page_id"]: r for r in wrappers.digest(spark.createDataFrame([*pages, *odd, pages[0]], "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i]["text"] == f"Head {i} One alpha{i * 37} & more line Two beta{i * 91} x"
    assert [got[i]["text"] for i in range(90, 96)] == ["Only this", "loose", "", "", "deep", "a < b & c"]
    assert got[90]["n_chars"] == 9
    assert wrappers.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_constants(pages):
    """Constant blocks of one host, counted in plain Python."""
    read = [{k for k, _ in wrappers.blocks(wrappers.parse(p))} for p in set(pages)]
    keys, places = {}, {}
    for own in read:
        for k in own:
            keys[k] = keys.get(k, 0) + 1
        for place in {k >> 32 for k in own}:
            places[place] = places.get(place, 0) + 1
    return sorted(k for k, n in keys.items() if n >= wrappers.LEAST and 2 * n > places[k >> 32])


def test_names_do_not_lose_text(spark):
    one = [(0, "https://a.example/", '<body><div class="content no-sidebar"><h1>T</h1><p>Text one</p></div></body>'),
           (1, "https://b.example/", '<article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>'),
           (2, "https://c.example/", '<article><div class="article-header"><h1>Title</h1></div><p>y</p></article>'),
           (3, "https://d.example/", '<article><section class="social policy"><p>Welfare</p></section></article>'),
           (4, "https://e.example/", '<body><div class="ad-slot">buy</div><div id="comments">spam</div><div class="site-footer">c</div><p>kept</p></body>')]
    got = {r["page_id"]: r["text"] for r in wrappers.digest(spark.createDataFrame(one, "page_id long, url string, html string")).collect()}
    assert got == {0: "T Text one", 1: "Title x", 2: "Title y", 3: "Welfare", 4: "kept"}


def test_constant_blocks_of_all_pages_go(spark):
    """Paragraphs, menus and footers that never change go, from both page shapes of a host and without article or main; equal
    pages, extra columns of clashing names and hosts of two pages change nothing."""
    first = '<body><div class="x"><ul><li>Home<li>Shop</ul></div><div class="y"><h1>H{0}</h1><p>Body {0}</p><p>Subscribe to our letter today</p></div><div class="z">All rights reserved</div></body>'
    other = '<body><table><tr><td>Home | Shop</td></tr></table><section><p>Other {0}</p></section><p>All rights reserved</p></body>'
    pages = [(i, "https://a.example/x", first.format(i)) for i in range(12)]
    pages += [(100 + i, "https://a.example/y", other.format(i)) for i in range(4)]
    pages += [(200 + i, "https://b.example/", f"<body><p>Same</p><p>only {i}</p></body>") for i in range(2)]
    pages += [(300 + i, "https://c.example/", "<body><p>All equal</p></body>") for i in range(5)]
    frame = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, constant string")
    out = wrappers.extract(frame)
    assert out.columns == ["page_id", "url", "html", "constant", "_found"]
    got = {r["page_id"]: r["_found"]["text"] for r in out.collect()}
    for i in range(12):
        assert got[i] == f"H{i} Body {i}"
    for i in range(4):
        assert got[100 + i] == f"Other {i}"
    assert [got[200 + i] for i in range(2)] == ["Same only 0", "Same only 1"]
    assert {got[300 + i] for i in range(5)} == {"All equal"}
    counted = {r["host"]: r["constant"] for r in wrappers.constants(frame, "url", "html").collect()}
    assert counted == {"a.example": plain_constants([p[2] for p in pages[:16]])}


def test_wrapper_is_made_from_all_pages(spark, monkeypatch):
    """A box that differs on one page of many is no template; neither partitions nor groups of shapes change the tree."""
    form = '<body><div class="menu"><a href="/">Home</a></div><div class="x"><h1>H{0}</h1><div class="y k{0}"><p>Body {0}</p>{2}</div><section class="note"><p>{1}</p></section></div></body>'
    pages = [(i, "https://a.example/x", form.format(i, "Only here" if i == 17 else "Same", "<table><tr><td>t</table>" * (i % 5) + "<hr>" * (i % 3)))
             for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.digest(frame).collect()}
    assert got[17].endswith("Only here") and got[17].startswith("H17 Body 17")
    assert all(got[i].startswith(f"H{i} Body {i}") and "Same" not in got[i] for i in range(40) if i != 17)
    monkeypatch.setattr(wrappers, "GROUP", 2, raising=False)
    made = [[tuple(r) for r in wrappers.wrappers(frame.repartition(n)).collect()] for n in (1, 7)]
    assert made[0] == made[1] and len(made[0]) == 1


def test_shared_folder_and_look_up(spark, docs, monkeypatch):
    assert shared_dir(spark)
    table = keep(spark.createDataFrame([(None, 1), ("s0", 2)], "source string, v int"), "t")
    small = sorted(map(str, look_up(docs, table, ["source"]).select("doc_id", "v").collect()))
    monkeypatch.setattr("screenwright.llm.common.BROADCAST_ROWS", 0)
    assert small == sorted(map(str, look_up(docs, table, ["source"]).select("doc_id", "v").collect()))
