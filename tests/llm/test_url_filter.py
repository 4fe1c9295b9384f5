import datetime as dt
import random

from vellum.llm import url_filter

T0 = dt.datetime(2024, 1, 1)
CAPTURES = "page_id long, url string, fetched_at timestamp_ntz, html string, list string, pattern string, day date"
ENTRIES = "list string, pattern string, action string, at timestamp_ntz, url string"


def slow(captures, entries):
    out = set()
    events = {}
    for lst, pat, action, at in entries:
        if pat is not None and at is not None and action in ("add", "remove"):
            held = events.setdefault((lst, pat.lower().removesuffix(".")), {})
            held[at] = max(held.get(at, "add"), action)
    for page, url, at in captures:
        hits = []
        host = None
        if url and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].rsplit("@", 1)[-1].lower()
            host = host[:host.index("]") + 1] if host.startswith("[") else host.split(":")[0].removesuffix(".")
        if host and at is not None:
            labels = host.split(".")
            address = host.startswith("[") or (len(labels) == 4 and all(x.isdigit() for x in labels))
            names = {host} if address else {".".join(labels[i:]) for i in range(len(labels))}
            for (lst, pat), held in events.items():
                past = [x for x in held if x <= at]
                if pat in names and past and held[max(past)] == "add":
                    hits.append((len(pat), pat, max(past), lst))
        best = max(hits, default=(0, None, None, None))
        out.add((page, url, at, bool(hits), len(hits), ",".join(sorted({h[3] for h in hits})), best[1], best[2]))
    return out


def run(spark, captures, entries):
    c = spark.createDataFrame([(*x, "<html>", "l", "p", None) for x in captures], CAPTURES)
    e = spark.createDataFrame([(*x, "u") for x in entries], ENTRIES)
    return {tuple(r) for r in url_filter.filter_captures(c, e).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.z.example.org", "HOT.example.net", "localhost", "example.org"]
    at = lambda: T0 + dt.timedelta(hours=rng.randrange(0, 24 * 40))
    entries = [(rng.choice(["l1", "l2"]), rng.choice(hosts), rng.choice(["add", "remove", "Add"]).lower(), at()) for _ in range(120)]
    entries += [("l1", None, "add", T0), ("l1", "a.example.com", None, T0), ("l1", "a.example.com", "add", None), ("l2", "b.example.com", "noted", T0)]
    entries += [("l3", "hot.example.net", "add", T0), ("l3", "hot.example.net", "remove", T0)]
    captures = [(i, f"http{'s' * (i % 2)}://{'u:p@' * (i % 5 == 0)}{rng.choice(hosts) if i % 3 else 'hot.example.net'}{':81' * (i % 7 == 0)}{rng.choice(['', '/a', '?q=1', '#f', './x'])}", at()) for i in range(400)]
    captures += [(500, None, T0), (501, "no host", T0), (502, "", T0), (503, "http://a.example.com/", None), (None, "http://a.example.com/", at()), (0, *captures[0][1:]), (504, "http://", T0)]
    assert run(spark, captures, entries) == slow(captures, entries)


def test_top_level_domains_addresses_and_final_dots(spark):
    entries = [("l", p, "add", T0) for p in ("xxx", "2.3", "10.9.9.9", "[2001:db8::1]", "b.com.", "B.NET")]
    urls = ["http://a.b.xxx/", "http://xxx/", "http://10.1.2.3/", "http://10.9.9.9:80/x", "https://[2001:DB8::1]:443/", "http://[2001:db8::2]/",
            "http://x.b.com/", "http://b.com./", "http://y.b.net", "http://axxx/", "http://1.2.3.com/"]
    got = {r[1]: r[3] for r in run(spark, [(i, u, T0) for i, u in enumerate(urls)], entries)}
    assert [got[u] for u in urls] == [True, True, False, True, True, False, True, True, True, False, False]
    assert run(spark, [(i, u, T0) for i, u in enumerate(urls)], entries) == slow([(i, u, T0) for i, u in enumerate(urls)], entries)


def test_an_entry_holds_from_its_instant_up_to_its_removal(spark):
    day = dt.timedelta(days=1)
    entries = [("l", "h.example.com", "add", T0 + day), ("l", "h.example.com", "remove", T0 + 2 * day)]
    captures = [(i, "http://h.example.com/", T0 + day * f) for i, f in enumerate((0.99, 1, 1.5, 1.99, 2, 3))]
    assert {r[0]: r[3] for r in run(spark, captures, entries)} == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_empty_tables(spark):
    assert run(spark, [], [("l", "h", "add", T0)]) == set()
    assert {r[3] for r in run(spark, [(1, "http://h/", T0)], [])} == {False}
