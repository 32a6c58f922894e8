import re
from collections import Counter, defaultdict

from tempora.llm import line_dedup

SCHEMA = "page_id long, url string, html string, host string, keys string, n long"
WHITE = " \t\n\x0b\x0c\r"


BLOCKS = """address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th
            title tr ul""".split()


def cut(html):
    """Lines end after a line feed and before the opening tag of a block element."""
    lines = [""]
    for i, char in enumerate(html):
        rest = html[i:].lower()
        if lines[-1] and (lines[-1][-1] == "\n" or any(rest.startswith((f"<{b} ", f"<{b}/", f"<{b}>")) for b in BLOCKS)):
            lines.append("")
        lines[-1] += char
    return [line for line in lines if line]


def brute(rows, percent, least):
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        host = (url or "").partition("://")[2].split("/")[0].lower() if "://" in (url or "") else ""
        hosts[host].append((page_id, cut(html or "")))
    out = []
    for host, pages in hosts.items():
        counts = Counter(k for _, lines in pages for k in {x.strip(WHITE) for x in lines} - {""})
        drop = {k for k, n in counts.items() if len(pages) >= least and n > 1 and 100 * n > percent * len(pages)}
        for page_id, lines in pages:
            kept = [x for x in lines if x.strip(WHITE) not in drop]
            out.append((page_id, host, len(lines), len(lines) - len(kept), "".join(kept)))
    return sorted(out, key=str)


ROWS = [(i, f"http://A.org/{i}", f"<nav>\n  menu {i % 2}\nbody {i}\n\n</nav>\r\nhalf<p class=x>para</p><p>own {i}</p><pa>" + ("\nrare" if i < 3 else "") + "\n<nav>") for i in range(8)]
ROWS += [(20 + i, f"https://b.net/{i}", "<nav>\nsame") for i in range(4)]                       # a small host
ROWS += [(30 + i, None if i % 2 else "no scheme", f"x\ny {i}") for i in range(6)]
ROWS += [(40, "http://A.org/40", None), (41, "http://A.org/41", ""), (None, "http://A.org/42", "half\nhalf"), (43, "http://c.org/", "z" * 500_000), (0, "http://A.org/0", ROWS[0][2])]


def test_equals_brute_force(spark, monkeypatch):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], SCHEMA)
    for percent, least in ((50, 5), (10, 1), (99, 5)):
        got = sorted(((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.without_boilerplate(frame, percent, least).collect()), key=str)
        assert got == brute(ROWS, percent, least)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", -1)
    got = sorted(((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.without_boilerplate(frame).collect()), key=str)
    assert got == brute(ROWS, 50, 1)


def test_small_hosts_are_judged(spark):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], SCHEMA)
    dropped = {r.page_id: r.n_dropped for r in line_dedup.without_boilerplate(frame).collect()}
    assert [dropped[20 + i] for i in range(4)] == [2] * 4 and dropped[43] == 0


def test_empty_table(spark):
    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in ROWS], SCHEMA)
    assert line_dedup.without_boilerplate(frame.limit(0)).collect() == []
