"""The path-template tree against a plain one, and on odd input."""

import math
import random
import re
import time
from collections import defaultdict

from lodeframe.llm import urlfilter


def plain_shape(seg):
    ext = (re.search(r"\.[A-Za-z]{1,5}$", seg) or [""])[0]
    stem = seg[: len(seg) - len(ext)]
    if re.fullmatch("[0-9]+", stem):
        return "{n}" + ext
    if re.fullmatch("[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem):
        return "{x}" + ext
    return "{s}" + ext if len(stem) > 40 else "=" + seg if seg[0] in "*~{=" else seg


def plain_class(seg):
    if not seg:
        return ""
    kind = seg[:3] if re.match(r"\{[nxs]\}", seg) else "word"
    return kind + ("." if re.search(r"\.[A-Za-z]{1,5}$", seg) else "")


def plain_divergence(a, b):
    n, m, out = sum(a), sum(b), 0.0
    for u, v in zip(a, b):
        pool = urlfilter.DRAWN * (u + v) / max(n + m, 1)
        p, q = (u + pool) / (n + urlfilter.DRAWN), (v + pool) / (m + urlfilter.DRAWN)
        out += (p * math.log2(2 * p / (p + q)) if p > 0 else 0) / 2 + (q * math.log2(2 * q / (p + q)) if q > 0 else 0) / 2
    return out


def plain_templates(pages):
    """{(host, key): (template, purity)} of (host, key, label) rows."""
    keys = defaultdict(lambda: [0, 0, 0])
    for host, key, label in pages:
        c = keys[host, key]
        c[0] += 1
        c[1] += label is not None
        c[2] += label == "block"
    out = {}

    def node(members, level, up):
        if len(members) == 1:
            out[members[0]] = "/".join([up, *members[0][1].split("/")[level:]])
            return
        children = defaultdict(list)
        for m in members:
            children[m[1].split("/")[level]].append(m)
        pages_ = sum(keys[m][0] for m in members)
        few = defaultdict(list)
        for seg, own in children.items():
            few[seg if sum(keys[m][0] for m in own) >= urlfilter.RARE * pages_ else "*"] += own
        profiles = {}
        for seg, own in few.items():
            shapes, labels = [0.0] * len(urlfilter.CLASSES), [0.0, 0.0]
            for m in own:
                t = m[1].split("/")
                n, seen, bad = keys[m]
                shapes[urlfilter.CLASSES.index(plain_class(t[level + 1] if len(t) > level + 1 else None))] += n
                labels[0] += seen - bad
                labels[1] += bad
            profiles[seg] = (shapes, labels)
        groups = {}
        for seg in sorted(few, key=lambda s: (-sum(keys[m][0] for m in few[s]), s)):
            lead = next((g for g in groups if all(plain_divergence(a, b) < urlfilter.DIVERGENCE for a, b in zip(profiles[g], profiles[seg]))), seg)
            groups.setdefault(lead, []).append(seg)
        for lead, segs in groups.items():
            name = "*" if lead == "*" else "~" + lead if len(segs) > 1 else lead
            own = [m for seg in segs for m in few[seg]]
            for m in own:
                if len(m[1].split("/")) == level + 1:
                    out[m] = f"{up}/{name}"
            deeper = [m for m in own if len(m[1].split("/")) > level + 1]
            if deeper:
                node(deeper, level + 1, f"{up}/{name}")

    for host in {h for h, _ in keys}:
        node([m for m in keys if m[0] == host], 0, "")
    sums = defaultdict(lambda: [0, 0, 0])
    for m, t in out.items():
        for i in range(3):
            sums[m[0], t][i] += keys[m][i]
    purity = {}
    for m, t in out.items():
        n, seen, bad = sums[m[0], t]
        more = urlfilter.PSEUDO + urlfilter.UNSEEN * (n - seen)
        purity[m] = (t, (bad + more / 2) / (seen + more))
    return purity


def judged(spark, urls):
    rows = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    return {r.page_id: r for r in rows}


def test_against_a_plain_tree(spark):
    made, urls = random.Random(1), []
    for h in range(6):
        first = made.sample(["es", "fr", "en", "it", "news", "*", "~es", "{n}", "tag"], 5)
        for _ in range(made.randint(20, 200)):
            parts = [made.choice(first)]
            for _ in range(made.randint(0, 4)):
                parts.append(made.choice(["a", "b", str(made.randint(0, 99)), "%x.html" % made.getrandbits(40), f"u{made.randint(0, 300)}", "x.php"]))
            urls.append(f"http://h{h}.{'net' if h % 3 else 'org'}/{'/'.join(parts)}{made.choice(['', '/'])}")
    urls += [f"http://many.net/user{i}/p" for i in range(250)] + [f"http://many.net/es/{i}" for i in range(50)] + urls[:20]
    out = judged(spark, urls)
    pages = []
    for i, url in enumerate(urls):
        host, path = re.fullmatch("[a-z]+://([^/]*)(.*)", url).groups()
        key = "/".join(plain_shape(s) for s in path.split("/") if s)
        pages.append((host, key, out[i].verdict if out[i].rule else None))
    want = plain_templates(pages)
    for i, (host, key, _) in enumerate(pages):
        template, purity = want[host, key]
        assert out[i].template == template and abs(out[i].purity - purity) < 1e-9
        assert out[i].verdict == ("block" if purity >= urlfilter.PURITY else "allow") or out[i].rule
    assert any(r.rule is None and r.verdict == "block" for r in out.values())


def test_an_unlabelled_branch_like_blocked_ones_is_rejected(spark):
    urls = [f"http://h.net/{s}/{i}" for s in ("es", "fr", "it") for i in range(60)]
    urls += [f"http://h.net/about/team/x{i}" for i in range(60)] + ["http://other.org/es/1"] + [f"http://much.net/{s}/{i}" for s, n in (("es", 10), ("en", 300)) for i in range(n)]
    out = judged(spark, urls)
    assert {out[i].verdict for i in range(180)} == {"block"} and out[150].rule is None
    # Other shapes, other hosts, and many pages for few blocked ones are left alone.
    assert all(r.verdict == "allow" for r in out.values() if r.page_id >= 180 and r.rule is None)


def test_branches_with_other_labels_stay_apart(spark):
    out = judged(spark, [f"http://a.example.com/{s}/{i}" for s in ("en", "fr") for i in range(50)])
    assert out[0].template != out[99].template and out[0].purity > 0.9 and out[99].purity < 0.1


def test_more_rows_of_the_same_kind_change_nothing(spark):
    urls = [f"http://h.net/{s}/{i}" for s, n in (("en", 300), ("es", 100), ("tag", 60)) for i in range(n)] + [f"http://h.net/u{i}x/p" for i in range(400)]
    one, ten = judged(spark, urls), judged(spark, urls * 10)
    assert [one[i].template for i in range(len(urls))] == [ten[i].template for i in range(len(urls))]
    assert {one[i].verdict for i in range(300)} == {ten[i].verdict for i in range(300)}


def test_odd_urls(spark):
    deep = "http://h.net/" + "/".join(["s"] * 4)
    urls = [None, "", "nothing", "http://", "http:///es/1", "http://h.net", "http://h.net/?a=/es/", "http://h.net/" + "x" * 50_000, "http://h.net/" + "/".join(map(str, range(400))), deep, deep + "/a", deep, deep, "http://H.NET//es//7/"]
    pages = spark.createDataFrame([(None if i == 3 else i, u, 1, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, `a.b` int, template string, host string")
    rows = urlfilter.judge(pages).collect()
    assert len(rows) == len(urls) and all(r.verdict in ("allow", "block") and r.template is not None for r in rows)
    out = {r.page_id: r for r in rows}
    assert out[9][1:] == out[11][1:] and out[13].rule is None and out[13].path == "//es//7/" and (out[0].host, out[0].path) == ("", "")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_deep_paths(spark):
    """Sixty shared segments, as in a crawler's trap, take sixty rounds of like cost."""
    deep = "/".join(f"part{chr(97 + i % 26)}" for i in range(60))
    rows = [(k, f"http://h.com/{deep}/{last}") for k, last in enumerate(("one", "two", "one"))]
    began = time.time()
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 3 and {r.verdict for r in got} == {"allow"} and {r.rule for r in got} == {"com/"}
    assert time.time() - began < 120
