"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, html_text, langid, mixing, near_dup, ogg, preference, quality, suffix_dedup, unit_dedup

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# mixing


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, _, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        pool = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        left = sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and weight[s] * pool / left > 2 * total[s]} if left else set()
        if not over:
            break
        full |= over
    return total, {s: 2.0 * total[s] if s in full else weight[s] * pool / left for s in sources}


def test_mixing(docs):
    rows = [(i, prose(RNG.randint(0, 60)), None, f"s{i % 5}" if i % 11 else None) for i in range(300)]
    rows += [(1000, None, None, "s1"), (1001, "", None, "empty"), (None, "a b", None, "s2"), (None, "a b", None, "s2"), (7, "one two\tthree\x0bfour", None, "é")]
    out = mixing.mix(docs(rows)).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    total, target = brute_mix(rows)
    assert len(out) == len(rows)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= max(largest[s], 1)
    again = mixing.mix(docs(list(reversed(rows)))).select("doc_id", "text", "taken").collect()
    assert Counter((r["doc_id"], r["text"], r["taken"]) for r in out) == Counter((r["doc_id"], r["text"], r["taken"]) for r in again)


def test_mixing_of_nothing(docs, spark):
    assert mixing.mix(docs([(1, "a", None, "s")]).where("false")).count() == 0
    r = mixing.mix(docs([(1, None, None, "s"), (2, "", None, "s")])).collect()
    assert [(x["taken"], x["target"]) for x in r] == [(0, 0.0), (0, 0.0)]


# suffix arrays


def brute_suffix(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "batches"), [(1000, 1), (1000, 5), (2, 3)])
def test_suffix_dedup(docs, monkeypatch, group, batches):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(3)
    passage, other = prose(110, rng), prose(70, rng)
    texts = [prose(rng.randint(0, 200), rng) for _ in range(25)]
    texts += [f"{prose(rng.randint(0, 60), rng)} {passage} {prose(rng.randint(0, 60), rng)}" for _ in range(12)]
    texts += [f"{prose(30, rng)}{passage[k:]}{prose(9, rng)}" for k in (0, 1, 100, 200)]
    texts += [other * 3, "é" * 900, "ab" * 500, None, "", "x", passage[:399], texts[0], texts[0], "ü" + passage + "ü"]
    found = suffix_dedup.dedup(docs([(i, t) for i, t in enumerate(texts)]), batches=batches).collect()
    got = {r["doc_id"]: (r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_suffix(texts, 400)


def test_suffix_index_levels(docs, spark):
    from tallyspark.llm.store import Workspace

    shared = prose(90)
    rows = [(i, prose(120)) for i in range(60)] + [(100, shared + "x"), (101, "y" + shared)]
    texts = docs(rows, extra=False).select(F.unhex(F.md5("text")).alias("digest"), "text").cache()
    batches = [texts.where(F.pmod(F.xxhash64("digest"), F.lit(8)) == i) for i in range(8)]
    index = suffix_dedup.SuffixIndex(Workspace(spark, "test"))
    total = 0
    for b in batches:
        index.add(b)
        total += suffix_dedup.entries(b).count()
        sizes = [x.size for x in index.levels]
        assert sum(sizes) == total == sum(x.array.count() for x in index.levels)
        assert all(older >= 2 * newer for older, newer in zip(sizes, sizes[1:-1], strict=False))  # all but the newest have merged
        assert all(x.directory.agg(F.sum("n")).first()[0] == x.size for x in index.levels)
    every = suffix_dedup.entries(texts).groupBy("fp").count().where("count > 1").select("fp")
    assert {r["fp"] for r in index.repeated().collect()} == {r["fp"] for r in every.collect()} != set()
    index.drop()
    assert index.levels == []


def test_suffix_strip_keeps_characters(docs):
    shared = "é" * 300
    rows = [(1, "a" + shared + "b", "en", "s"), (2, "xyz" + shared + "ü", "en", "s"), (3, None, "en", "s")]
    out = {r["doc_id"]: r for r in suffix_dedup.strip(docs(rows)).collect()}
    assert out[1]["text"] == "ab" and out[1]["n_chars"] == 2 and out[2]["text"] == "xyzü" and out[3]["text"] is None
    assert suffix_dedup.strip(docs(rows).where("false")).count() == 0


# preference pairs


def test_preference(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
        (1, 0, "system", "é"), (1, 1, "user", "hi"), (1, 2, "assistant", "c"),
        (2, 0, "user", "alone"), (2, 1, "assistant", "z"), (4, 0, None, None), (4, 1, "assistant", "same"), (5, 1, "assistant", "same"),
        (None, 0, "user", "lost"), (6, None, "user", "lost"), (6, 0, "user", "p"), (6, 0, "user", "p"), (7, 0, "user", "p"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash")).withColumn("side", F.lit("x"))
    out = preference.format_pairs(preference.other_replies(table))
    got = {r["pair_id"]: r for r in out.collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert len(got) == 7 and {r["segment"] for r in got.values()} == {0}
    assert got[0]["prompt"] == say("user", "hi") + say("assistant", "a") + say("user", "x")
    assert got[0]["chosen"] == say("assistant", "b") + say("user", "bye") and got[0]["rejected"] == say("assistant", "c")
    marked = lambda r, s: [r[s][x["start"] : x["start"] + x["n"]] for x in r[f"{s}_spans"]]
    assert marked(got[0], "chosen") == ["b<|im_end|>"] and marked(got[0], "rejected") == ["c<|im_end|>"]
    assert got[1]["prompt"] == say("system", "é") + say("user", "hi") and got[1]["rejected"] == say("assistant", "b")
    assert got[2]["prompt"] == got[2]["rejected"] == "" and marked(got[2], "chosen") == ["z<|im_end|>"]  # nobody to take a reply from
    assert got[4]["prompt"] == say("unknown", "") + say("assistant", "same") and got[4]["chosen"] == got[4]["rejected"] == ""
    assert got[6]["chosen"] == say("user", "p") * 2 and got[6]["chosen_spans"] == []
    assert preference.format_pairs(preference.other_replies(table.where("false"))).count() == 0


def test_preference_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(p, s, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "long " * 3000 if t == 5 else "c"])) for p in range(40) for t in range(rng.randint(1, 30)) for s in ("chosen", "rejected") if rng.random() < 0.97]
    twin = {(p, t): (r, x) for p, s, t, r, x in rows if s == "chosen"}
    rows = [(p, s, t, *(twin.get((p, t), (r, x)) if t < p % 23 else (r, x))) for p, s, t, r, x in rows]
    sides = {}
    for p, s, t, r, x in rows:
        sides.setdefault(p, {"chosen": [], "rejected": []})[s].append((t, r or "unknown", x or ""))
    out = {}
    for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"), 7).orderBy("pair_id", "segment").collect():
        for k in ("prompt", "chosen", "rejected"):
            out.setdefault(r["pair_id"], {}).setdefault(k, []).append(r[k])
    for p, both in sides.items():
        c, r = sorted(both["chosen"]), sorted(both["rejected"])
        first = next((t for t in range(40) if [m for m in c if m[0] == t] != [m for m in r if m[0] == t]), 99)
        said = lambda ms: "".join(f"<|im_start|>{role}\n{x}<|im_end|>\n" for _, role, x in ms)
        assert "".join(out[p]["prompt"]) == said(m for m in c if m[0] < first)
        assert "".join(out[p]["chosen"]) == said(m for m in c if m[0] >= first) and "".join(out[p]["rejected"]) == said(m for m in r if m[0] >= first)


# weak labels


def test_quality(docs, spark):
    rng = random.Random(2)
    good = [(i, ". ".join(prose(12, rng) for _ in range(6)) + ".") for i in range(300)]
    shout = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(50, rng).split())) for i in range(40)]
    noise = [(2000 + i, " ".join(w + "***" for w in prose(50, rng).split())) for i in range(40)]
    rows = [*good, *shout, *noise, (3000, None), (3001, " \n"), (None, good[0][1])]
    out = quality.classify(docs(rows)).collect()
    assert len(out) == len(rows)
    score = {r["doc_id"]: r for r in out}
    kept = {k for k, r in score.items() if r["keep"]}
    assert len(kept & {i for i, _ in good}) >= 295 and not kept & {i for i, _ in [*shout, *noise]} and None in kept
    assert score[3000]["score"] == 0 and not score[3000]["keep"] and not score[3001]["keep"]
    assert quality.classify(docs(rows).where("false")).count() == 0


# Ogg


def test_ogg_columns(docs):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "x" * 193), (4, "x" * 193), (None, "y" * 70_000)]
    out = ogg.round_trip(docs(rows)).collect()
    by = {(r["doc_id"], r["n_bytes"]): r for r in out}
    assert len(out) == 6 and by[1, 0]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() == by[2, 0]["payload_sha256"]
    assert by[3, 192]["payload_bytes"] == 192 and by[4, 193]["payload_bytes"] == 384
    media = ogg.media_column(docs(rows))
    assert {hashlib.sha256(r["media"]).hexdigest() for r in media.collect()} == {r["media_sha256"] for r in out}
    packets = ogg.packet_table(media.where("doc_id is null")).where(F.col("serial") == ogg.SAMPLES).orderBy("packet").collect()
    assert b"".join(p["data"] for p in packets[1:]).rstrip() == b"y" * 70_000 and packets[-1]["seconds"] == pytest.approx(70_080 / ogg.RATE)
    assert ogg.round_trip(docs(rows).where("false")).count() == 0


# decontamination


def brute_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for k, item in items:
            x = words(item)
            n = min(10, len(x))
            windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(str(k))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("small", [200_000, 0])
def test_decontamination(docs, spark, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    rng = random.Random(9)
    items = [(i, prose(n, rng)) for i, n in enumerate((30, 10, 11, 9, 3, 1, 0, 40))] + [(20, None), (21, "Éa ÉB c D e f g h i j k"), (22, "z " * 30)]
    base = prose(50, rng)
    texts = [f"{prose(20, rng)}, {t.title() if t and i % 2 else t} - {prose(5, rng)}" for i, (_, t) in enumerate(items)]
    items += [(23, "ΟΔΟΣ ΑΒ Σ δ ΕΣ ζ η θ ΙΣ κ"), (24, "ΣΑΣ β")]
    texts += ["x ΟΔΟΣ.ΑΒ'Σ δ ΕΣ ζ-η θ ΙΣ'κ y", "οδος ΑΒ Σ δ ΕΣ ζ η θ ΙΣ κ", "ΣΑΣ.β"]
    texts += ["éa éb c d e f g h i j k", "ÉA ÉB C d e f g h i j k", None, "", "!!", base, base, items[0][1][20:120], "z " * 500, "z " * 9]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    out = {r["doc_id"]: r for r in decontaminate.report(docs(list(enumerate(texts))), bench).collect()}
    got = [(out[i]["n_words"], out[i]["n_hit"], out[i]["items"]) for i in range(len(texts))]
    assert got == brute_hits(texts, items)
    kept = {r["doc_id"] for r in decontaminate.clean(docs(list(enumerate(texts))), bench).collect()}
    assert kept == {i for i, (_, n, _) in enumerate(got) if not n}
    assert decontaminate.report(docs([(1, base)]), bench.where("false")).first()["n_hit"] == 0
    assert decontaminate.report(docs([(1, base)]).where("false"), bench).count() == 0


# lines


def test_unit_dedup(docs):
    a, b = "one two three four five six", "Seven  eight nine ten eleven"
    rows = [(2, f"{a}\n{b}\nshort"), (1, f"x y\n{b.lower()}\n{a.upper()} tail"), (3, f"{a}\n{a}\né {a}"), (None, a), (5, None), (6, ""), (3, f"{a}\n{a}\né {a}")]
    out = unit_dedup.dedup(docs(rows)).collect()
    kept = {(r["doc_id"], r["text"]): bytes(r["kept"] or b"").decode() for r in out}
    assert len(out) == 7
    assert kept[1, rows[1][1]] == rows[1][1]  # document 1 ranks first for the second line
    assert kept[2, rows[0][1]] == f"{a}\nshort" and kept[3, rows[2][1]] == f"é {a}" and kept[None, a] == "" and kept[6, ""] == ""
    spans = {r["doc_id"]: [(s["start"], s["n_bytes"]) for s in r["removed"]] for r in out}
    assert spans[2] == [(len(a) + 1, len(b) + 1)] and spans[3] == [(0, 2 * len(a) + 2)]
    assert unit_dedup.dedup(docs(rows).where("false")).count() == 0


# main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="site-menu"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></div><div id=cookie-notice>We use cookies to make this site work for you.</div>
<article><header><h1>Title &amp; more</h1><span>by someone</span></header><p>First   paragraph of the
 article, <b>long</b> enough to count.</p><p>Ok.</p><aside>Read also this other very long and interesting article here.</aside>
<form><label>Mail</label><input></form><p>Last paragraph&nbsp;of the article, long enough too.</p>
<section class="comments"><article><p>Great article, I read it twice and sent it to all my friends.</p></article></section></article>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph of the article, long enough to count.\n\nOk.\n\nLast paragraph of the article, long enough too."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><h1>A</h1><p><b>One two.<br><p>Three four.</p></article><footer>f") == "A\n\nOne two.\n\nThree four."
    assert html_text.main_text("<nav><a>x</a><article><p>unclosed menu before the text</p></article>") == "unclosed menu before the text"


def test_main_text_of_planted_articles():
    rng = random.Random(31)
    esc = lambda t: t.replace("&", "&amp;")
    for k in range(60):
        blocks = [prose(rng.randint(3, 9), rng).title(), *(prose(rng.choice((2, 30, 60, 200)), rng) + " & more." for _ in range(rng.randint(3, 12)))]
        inner = [f"<h1>{esc(blocks[0])}</h1>", *(f"<p>{esc(b)}" + rng.choice(["</p>", ""]) if i % 4 else f'<section class="related-work"><p>{esc(b)}</p></section>' if len(b) > 150 else f"<p>{esc(b)}</p>" for i, b in enumerate(blocks[1:]))]
        junk = lambda: rng.choice(['<div class="ad">Buy {}</div>', "<aside>{}</aside>", "<form><label>{}</label><input></form>", '<div class="cookie-notice"><p>{}</p></div>', "<script>var x='{}'</script>", "<nav><a href=x>{}</a></nav>"]).format(prose(rng.randint(1, 30), rng))
        for _ in range(rng.randint(0, 3)):
            inner.insert(rng.randint(1, len(inner)), junk())
        menu = "<nav><ul>" + "".join(f"<li><a href=/{w}>{w}</a>" + rng.choice(["</li>", ""]) for w in prose(8, rng).split()) + "</ul></nav>"
        comments = "".join(f"<div class=comment><p>{prose(40, rng)}</p></div>" for _ in range(rng.randint(0, 3)))
        body = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>']).format("\n".join(inner))
        page = f"<html><head><title>x</title></head><body>{menu}{junk()}{body}<section id=comments>{comments}</section><footer>{prose(20, rng)}</footer></body></html>"
        assert html_text.main_text(page) == "\n\n".join(blocks), k


def test_main_text_is_linear_and_drops_no_article_text():
    import time

    long = prose(80)
    kept = html_text.main_text(f'<article><h1>T</h1><p>{long}</p><div class="promo"><p>{long} x</p></div><p class="share">Share</p><ul><li><a href=x>{long}</a><li>b</ul></article>')
    assert kept == f"T\n\n{long}\n\n{long} x\n\n{long}\n\nb"
    linked = html_text.main_text(f"<div><p>{long}</p><p>{long}</p><p><a href=x>a linked line</a></p><p>{long}</p></div><p><a href=y>elsewhere</a>")
    assert "a linked line" in linked and "elsewhere" not in linked
    for broken in ("<div><span>word", "<li>word ", "<ul><li>x", "<u><div><b>x", "<p><b>x"):
        began = time.process_time()
        assert "x" in html_text.main_text(broken * 8000 + "</u>" * 8000 + "x")
        assert time.process_time() - began < 2


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(pages).collect()
    assert sorted(len(r["text"]) for r in out) == [0, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))]
    assert html_text.extract(pages.where("false")).count() == 0


# near duplicates


def brute_groups(texts, least=0.8):
    shingles = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        seen = Counter()
        labelled = []
        for x in s:
            labelled.append((x, seen[x]))
            seen[x] += 1
        shingles.append(labelled)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            a, b = shingles[i], shingles[j]
            at = {x: k for k, x in enumerate(b)}
            path = [at[x] for x in a if x in at]
            tails = []
            import bisect

            for x in path:
                k = bisect.bisect_left(tails, x)
                tails[k : k + 1] = [x]
            m = len(tails)
            if texts[i] == texts[j] or m and m / (len(a) + len(b) - m) >= least:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_near_dup(docs):
    rng = random.Random(21)

    def edited(t, k):
        w = t.split()
        for i in rng.sample(range(len(w)), k):
            w[i] = rng.choice(VOCABULARY)
        return " ".join(w)

    base, second = prose(150, rng), prose(300, rng)
    texts = [prose(rng.randint(1, 120), rng) for _ in range(30)]
    texts += [base, *(edited(base, k) for k in (1, 1, 2, 2, 3, 3, 8, 8) for _ in range(6))]
    texts += [second, second.upper(), second.replace(" ", ", "), edited(second, 4), f"{base} {second}", base, base, "a b c", "a b c d", "A b; c", "", "", "!!", None, None]
    texts += [prose(40, rng) + " " + base for _ in range(6)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, texts[i]) for i in ids]
    out = {r["doc_id"]: r for r in near_dup.classes(docs(rows)).collect()}
    assert [out[i]["class_id"] for i in range(len(texts))] == brute_groups(texts)
    kept = sorted(r["doc_id"] for r in near_dup.dedup(docs([*rows, rows[0], rows[-1]])).collect())
    assert sorted(set(kept)) == sorted(set(brute_groups(texts)))
    nulls = [i for i in (ids[0], ids[-1]) if texts[i] is None]
    tiny = [prose(n, rng) for n in (8, 9, 10, 12, 14, 16) for _ in range(25)]
    tiny += [f"{t} {prose(n, rng)}" for t in tiny for n in (1, 2)] + [f"{prose(1, rng)} {t}" for t in tiny]
    grouped = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs(list(enumerate(tiny)))).collect()}
    assert [grouped[i] for i in range(len(tiny))] == brute_groups(tiny)
    assert len(kept) == len(set(kept)) + len(nulls)
    assert near_dup.classes(docs(rows).where("false")).count() == 0 and near_dup.dedup(docs(rows).where("false")).count() == 0
    lost = near_dup.classes(docs([(None, base), (4, base), (None, None)])).collect()
    assert sorted((r["doc_id"] is None, r["class_id"], r["class_size"]) for r in lost if r["text"]) == [(False, 4, 2), (True, 4, 2)]


# language


def test_language(docs):
    rng = random.Random(4)
    alphabets = {"aa": "abcde", "bb": "fghij", "éé": "éèàçù"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(4)) for _ in range(40)), k) for i, k in enumerate(list(alphabets) * 30)]
    rows += [(500, None, "aa"), (501, "123 !!", "aa"), (502, "", None), (None, rows[0][1], None), (503, rows[1][1].upper(), None)]
    table = docs(rows)
    held = langid.fold() == 2
    out = langid.predict(table.withColumn("held", held), langid.learn(table.where(~held))).collect()
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == k for i, _, k in rows[:90]) and all(0 <= r["score"] <= 1 for r in out)
    assert [by[i]["lang_pred"] for i in (500, 501, 502, None, 503)] == ["und", "und", "und", "aa", "bb"]
    empty = langid.learn(table.where("false"))
    assert empty.count() == 0 and {r["lang_pred"] for r in langid.predict(table, empty).collect()} == {"und"}
    assert langid.predict(table.where("false"), langid.learn(table)).count() == 0


def brute_units(rows, run=20):
    """Removed and passage bytes of (key, text) rows, in strings and lists only."""
    ranked = sorted({(k is None, k or 0, hashlib.md5(t.encode()).digest(), t) for k, t in rows if t is not None})

    def split(t):
        out, at = [], 0
        for line in t.split("\n"):
            whole = (at, min(at + len(line) + 1, len(t)))
            cuts = [at, *(at + m.end() for m in re.finditer(r"[.!?]+[ \t]+", line) if m.end() < len(line)), whole[1]]
            out.append((whole, list(zip(cuts, cuts[1:])) if len(cuts) > 2 else []))
            at = whole[1]
        return out

    norm = lambda t, s: " ".join(t[s[0] : s[1]].lower().split())
    seen, times = {}, Counter()
    for i, (*_, t) in enumerate(ranked):
        for whole, inner in split(t):
            for j, s in enumerate([whole, *inner]):
                if norm(t, s):
                    times[norm(t, s)] += 1
                    seen.setdefault(norm(t, s), (i, whole[0], j))
    result = {}
    for i, (_, _, _, t) in enumerate(ranked):
        later = lambda s, at, j: norm(t, s) in seen and seen[norm(t, s)] != (i, at, j)
        pieces = []
        for whole, inner in split(t):
            if later(whole, whole[0], 0) or not inner:
                pieces.append((whole, True, later(whole, whole[0], 0)))
            else:
                pieces += [(s, False, later(s, whole[0], j)) for j, s in enumerate(inner, 1)]
        pieces = [p for p in pieces if norm(t, p[0])]
        gone, marked = set(), set()
        for into, want in ((gone, lambda p: p[2]), (marked, lambda p: times[norm(t, p[0])] > 1)):
            k = 0
            while k < len(pieces):
                e = k
                while e < len(pieces) and want(pieces[e]):
                    e += 1
                long = sum(len(norm(t, p[0]).split()) for p in pieces[k:e]) >= run
                if long:
                    into |= set(range(pieces[k][0][0], pieces[e - 1][0][1]))
                elif into is gone:
                    into |= {x for p in pieces[k:e] if p[1] for x in range(*p[0])}
                k = e + 1
        result[t] = len(gone), len(marked), "".join(c for x, c in enumerate(t) if x not in gone)
    return result


def test_unit_dedup_against_brute_force(docs):
    rng = random.Random(17)
    sentence = lambda n: prose(n, rng).capitalize() + rng.choice([".", "!", ". ", "?"])
    pool = [sentence(rng.randint(1, 9)) for _ in range(60)]
    passage = " ".join(sentence(9).strip() for _ in range(6))
    rows = [(i, "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.4 else sentence(rng.randint(1, 12)) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    rows += [(100 + i, f"{prose(9, rng)} {passage} {prose(7, rng)}\n\n{prose(4, rng)}") for i in range(4)]
    rows += [(None, passage), (None, "Yes.\nYes."), (7, rows[3][1]), (200, ""), (201, "\n \n"), rows[5], (300, f"{prose(9000, rng)}. {passage}")]
    expected = brute_units(rows)
    out = unit_dedup.dedup(docs(rows), min_words=1).collect()
    assert len(out) == len(rows)
    for r in out:
        gone, marked = (sum(x["n_bytes"] for x in r[c]) for c in ("removed", "passages"))
        if sum(t == r["text"] for _, t in rows) == 1:  # of equal texts each has a rank of its own
            assert (gone, marked, bytes(r["kept"]).decode()) == expected[r["text"]]
    long = {r["doc_id"]: sum(x["n_bytes"] for x in r["passages"]) for r in out}
    assert all(long[100 + i] > 250 for i in range(4)) and long[300] > 250
    keyed = unit_dedup.dedup(docs([(1, "a b"), (2, "a b")]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), min_words=1).collect()
    assert sorted((r["doc_id"], bytes(r["kept"])) for r in keyed) == [("k1", b"a b"), ("k2", b"")]


def test_unit_dedup_query_takes_short_lines(docs, tmp_path):
    from tallyspark.llm import queries

    docs([(1, "Yes.\n\none two three four\nx"), (2, "a\n yes. \n\nOne two  three four\nyes.\nb")], extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op7_lines(docs([]).sparkSession, str(tmp_path)).collect()}
    assert out[1]["n_removed"] == 0 and out[2]["removed_spans"] == "2+7,10+25"
    assert out[2]["kept_sha256"] == hashlib.sha256(b"a\n\nb").hexdigest() and out[2]["n_removed"] == 32
