"""Tables of sections from one pass, against their nodes; what judging them stores and shuffles."""

import random

from formloom.operators import repeat_fill
from formloom.plans import parts
from formloom.sources import containers, markup, packages, sections

SF = "/root/testdata/sf0.001"
OWN = containers.PARAGRAPH


CHILD = {"tbl": "tr", "tr": "tc", "tc": "p", "p": "run", "run": "t"}


def grown(r, depth, up=None):
    """Elements that hold each other in any way, though more often as they do in sound tables."""
    if not depth:
        return r.choice(["", "x", "é &amp; y", "<hp:lineBreak/>", "<hp:tab/>"])
    name = CHILD[up] if up in CHILD and r.random() < 0.6 else r.choice(["tbl", "tr", "tr", "tc", "tc", "p", "p", "run", "run", "t", "t", "sz", "pos", "cellAddr", "cellSpan", "cellSz", "linesegarray", "rect"])
    inner = "".join(grown(r, depth - 1, name) for _ in range(r.randint(0, 3)))
    number = r.choice(["1", "22", "x", "1234567890"])
    return f'{r.choice(["", "w"])}<hp:{name} id="{r.randint(0, 3)}" rowAddr="{number}" colAddr="2" rowSpan="{number}" width="{number}" borderFillIDRef="{number}">{inner}</hp:{name}>{r.choice(["", "z"])}'


def by_nodes(body):
    """What table_rows says, from all nodes of a part."""
    nodes = markup.nodes_of(body)
    own = lambda n, *local: n["ns"] == OWN and n["local"] in local
    up = lambda n: nodes[n["parent"]] if n["parent"] is not None else None
    kids = lambda n, *local: [k for k in nodes if k["parent"] == n["node"] and own(k, *local)]
    span = lambda n: (n["start"], n["stop"])

    def inner(n, local, but=False):
        n = up(n) if but else n
        while n and not own(n, local):
            n = up(n)
        return n

    def in_cell(n, cell):
        """The cell is the innermost one around n, with no table between them."""
        at = up(n)
        while at and not own(at, "tc", "tbl"):
            at = up(at)
        return at is cell

    def said(p):
        out = ""
        for n in nodes:
            if inner(n, "p") is p and up(n) and own(up(n), "t"):
                out += n["text"] if n["local"] == "#text" else {"lineBreak": "\n", "tab": "\t"}.get(n["local"], packages.OBJECT)
        return out

    def first(found, name):
        value = found[0]["attrs"].get(name, "") if found else ""
        return int(value) if value.isascii() and value.isdigit() and len(value) < 10 else None

    def cell(c):
        ps = [n for n in nodes if own(n, "p") and in_cell(n, c)]
        runs = [(*span(n), n["name"], [(*span(k), k["name"]) for k in kids(n, "t")]) for n in nodes if own(n, "run") and in_cell(n, c)]
        addr, of, size = kids(c, "cellAddr"), kids(c, "cellSpan"), kids(c, "cellSz")
        places = (addr[0]["start"], addr[0]["open_end"]) if addr else (None, None)
        numbers = (first(addr, "rowAddr"), first(addr, "colAddr"), *places, first(of, "rowSpan"), first(of, "colSpan"), first(size, "width"), first(size, "height"))
        return (c["start"], c["open_end"], c["attrs"].get("borderFillIDRef"), *numbers, "\n".join(map(said, ps)) if ps else None, runs, [span(n) for n in nodes if own(n, "linesegarray") and in_cell(n, c)])

    out = []
    for n in nodes:
        if own(n, "tbl"):
            p = inner(n, "p")
            nested = inner(n, "tbl", True) is not None or any(k is not n and own(k, "tbl") and n["start"] < k["start"] < n["stop"] for k in nodes)
            child = lambda local: (len(f := kids(n, local)), *((f[0]["start"], f[0]["open_end"], f[0]["attrs"]) if f else (None, None, None)))  # noqa: B023, E731
            rows = [(*span(tr), [cell(c) for c in kids(tr, "tc")]) for tr in kids(n, "tr")]
            out.append((n["node"], n["attrs"].get("id"), p and up(p) and up(p)["local"], nested, n["start"], n["open_end"], len(body), n["attrs"], child("sz"), child("pos"), [span(k) for k in kids(p, "linesegarray")] if p else [], rows))
    return out


def plain(x):
    return tuple(plain(v) for v in x) if isinstance(x, tuple) else [plain(v) for v in x] if isinstance(x, list) else x


def test_tables_are_what_their_nodes_say(spark):
    r = random.Random(5)
    bodies = [f'<hs:sec xmlns:hs="s" xmlns:hp="{OWN}">{"".join(grown(r, 8) for _ in range(4))}</hs:sec>'.encode() for _ in range(150)]
    bodies += [parts.grid(parts.SOUND).join([f'<hs:sec xmlns:hs="s" xmlns:hp="{OWN}">', "</hs:sec>"]).encode(), b"<torn", b"", b"<sec/>"]
    made = spark.createDataFrame([(str(i), "s", bytearray(b)) for i, b in enumerate(bodies)], "path string, part string, body binary")
    got = {}
    for row in sorted(sections.table_rows(made).collect(), key=lambda x: x.table):
        got.setdefault(int(row.path), []).append(plain(tuple(row)[2:]))
    for i, body in enumerate(bodies[:-3]):
        assert got.get(i, []) == by_nodes(body), i
    assert not set(got) & {len(bodies) - k for k in (1, 2, 3)}
    cells = [c for tables in got.values() for t in tables for row in t[-1] for c in row[-1]]
    assert sum(t[3] for tables in got.values() for t in tables) > 20 and sum(c[-3] not in (None, "") for c in cells) > 20 and sum(bool(c[-1]) for c in cells) > 5 and sum(any(x[3] for x in c[-2]) for c in cells) > 5


def test_verdicts_store_nothing_and_shuffle_little(spark):
    """Packages, their nodes and markup stay in the task that makes them: only keys, regions and what is looked at of a table are dealt."""
    plan = parts.hwpx_repeat_verdicts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and plan.count("Exchange ") <= 5


def test_regions_without_tables_or_rows_have_their_reasons(spark):
    """No table, two, none with rows, an own row without cells, and a malformed part."""
    sound = parts.grid(parts.SOUND)
    bodies = {"none": "", "two": sound * 2, "bare": sound[: sound.index("<hp:tr>")] + sound[sound.rindex("</hp:tr>") + 8 :], "cells": sound.replace("</hp:tr>", "</hp:tr><hp:tr/>", 1).replace('rowCnt="5"', 'rowCnt="6"'), "torn": "<", "sound": sound}
    docs = spark.createDataFrame([(k, "hwpx", v) for k, v in bodies.items()], "path string, format string, body string")
    got = {x.path: x.reason for x in repeat_fill.verdicts(parts.region(docs), parts.field_tables(packages.make_packages(docs))).collect()}
    assert got == {"none": "missing-table", "two": "ambiguous-table", "bare": "invalid-row-range", "cells": "unsupported-row-shape", "torn": "missing-table", "sound": None}


def test_filling_stores_each_step_once(spark, monkeypatch):
    """Parts, tables with their regions, verdicts and what is filled are stored, nothing else; no node becomes a row."""
    stored, walked = [], []
    for module in (parts, repeat_fill):
        monkeypatch.setattr(module, "cut", lambda df, f=module.cut: stored.append(df.columns) or f(df))
    monkeypatch.setattr(parts, "node_rows", lambda df: walked.append(df))
    got = parts.hwpx_repeat_fill(spark, SF)
    assert len(stored) == 4 and not walked and not any("attrs" in c and "depth" in c for c in stored)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").selectExpr("count(*) + 2 * count(distinct o_custkey)").first()[0]
