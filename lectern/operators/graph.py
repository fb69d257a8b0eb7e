"""Dependency graphs as edge tables (book, src, dst, source): derivation, cycles, tiers, order.

Books are small next to a table of them, so cycles and tiers are walked book by book in grouped
functions; the books that are too large for one worker, and these alone, go through loops over written tables,
which end when nothing changes. The exact depth-first walk of a book's cyclic core is a grouped function in any case.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.sources.store import kept

PRIORITY = ("explicit", "implicit", "cross_theme", "inferred")
#: Edges of a book that one worker walks at most.
BOOK_EDGES = 500_000


def unify_keys(edges: DataFrame) -> DataFrame:
    """(book, src, dst) from tables that name the ends from/source/prereq and to/target/concept; the first that is filled counts."""
    pick = lambda names: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names if c in edges.columns])
    return edges.select("book", pick(["from", "source", "prereq"]).alias("src"), pick(["to", "target", "concept"]).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def known_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose source is a concept of the book."""
    return edges.join(concepts.select("book", F.col("concept").alias("src")).distinct(), ["book", "src"], "left_semi")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst) of a book, by priority of its source, then ord; no loops."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source"))
    first = F.row_number().over(W.partitionBy("book", "src", "dst").orderBy(rank, "ord"))
    return edges.filter("src <> dst").withColumn("first", first).filter("first = 1").select("book", "src", "dst", "source")


#: Characters of a gram by which contained strings are found.
GRAM = 4


def _grams(low: Column, n: int) -> Column:
    """The different runs of n characters of a string; none of a shorter one."""
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n)))
    return F.when(F.length(low) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def indexed(hay: DataFrame) -> DataFrame:
    """(book, gram, hay, hay_low) of ``hay`` (book, hay, low): grams of 1 to GRAM characters, and the empty one.

    The table is written, so that joins know how large it is.
    """
    grams = F.concat(F.array(F.lit("")), *[_grams(F.col("low"), n) for n in range(1, GRAM + 1)])
    return kept(hay.select("book", "hay", F.col("low").alias("hay_low"), F.explode(grams).alias("gram")), "grams")


def rarest_grams(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(book, needle, low, gram, n): of each needle (book, needle, low) the gram that fewest strings of ``indexed`` hold, and how many.

    A needle of fewer than GRAM characters is its own gram. Needles with a gram that no string holds are left out, as none contains them.
    """
    own = F.when(F.length("low") >= GRAM, _grams(F.col("low"), GRAM)).otherwise(F.array("low"))
    asked = kept(needles.select("book", "needle", "low", F.explode(own).alias("gram")), "needle-grams")
    held = index.join(asked.select("book", "gram").distinct(), ["book", "gram"], "left_semi").groupBy("book", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(held, ["book", "gram"], "left")
    least = asked.groupBy("book", "needle", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return least.filter("r.n > 0").select("book", "needle", "low", "r.gram", "r.n")


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(book, needle, hay): each needle with the strings of its book that contain it (by ``low``), met by the needle's rarest gram alone."""
    index = indexed(hay)
    met = kept(rarest_grams(needles, index), "rarest-grams").join(index, ["book", "gram"])
    return met.filter(F.col("hay_low").contains(F.col("low"))).select("book", "needle", "hay")


def match_terms(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(book, term, concept): equal, else the first concept (by ord) that contains the term or that it contains, without case.

    Equal names are joined first. Of what is left, both ways of containment go through an index of short grams, where the rarest gram of the
    contained string picks what is compared. Null terms and concepts match nothing; an empty one is contained in all.
    """
    asked = terms.select("book", "term").filter("term IS NOT NULL").distinct()
    names = kept(concepts.select("book", "concept", "ord").filter("concept IS NOT NULL").groupBy("book", "concept").agg(F.min("ord").alias("ord")), "names")
    equal = asked.join(names.select("book", F.col("concept").alias("term")), ["book", "term"], "left_semi").withColumn("concept", F.col("term"))
    rest = kept(asked.join(equal.select("book", "term"), ["book", "term"], "left_anti"), "open-terms")
    as_ = lambda df, c, to: df.select("book", F.col(c).alias(to), F.lower(c).alias("low"))
    inside = containing(as_(rest, "term", "needle"), as_(names, "concept", "hay")).select("book", F.col("needle").alias("term"), F.col("hay").alias("concept"))
    around = containing(as_(names, "concept", "needle"), as_(rest, "term", "hay")).select("book", F.col("hay").alias("term"), F.col("needle").alias("concept"))
    met = inside.unionByName(around).join(names, ["book", "concept"])
    return equal.unionByName(met.groupBy("book", "term").agg(F.min_by("concept", "ord").alias("concept")))


def orphans(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("book", F.col("src").alias("concept")).unionByName(edges.select("book", F.col("dst").alias("concept")))
    return concepts.select("book", "concept").join(ends.distinct(), ["book", "concept"], "left_anti")


def graph_counts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    n = concepts.groupBy("book").agg(F.count(F.lit(1)).alias("total_concepts"))
    e = edges.groupBy("book").agg(F.count(F.lit(1)).alias("total_edges"))
    o = orphans(concepts, edges).groupBy("book").agg(F.count(F.lit(1)).alias("orphan_count"))
    return n.join(e, "book", "left").join(o, "book", "left").na.fill(0)


def _table(pdf: pd.DataFrame, **columns: list) -> pd.DataFrame:
    """A group's result with its book; an empty one keeps plain object columns."""
    n = len(next(iter(columns.values())))
    return pd.DataFrame({"book": pd.Series([pdf["book"].iloc[0]] * n, dtype=object)} | {k: pd.Series(v, dtype=object) for k, v in columns.items()})


def _apart(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The edges of books that one worker walks, those of larger books (None without any), and the larger books."""
    large = kept(edges.groupBy("book").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BOOK_EDGES).select("book"), "large-books")
    if large.isEmpty():
        return edges, None, large
    return edges.join(large, "book", "left_anti"), edges.join(large, "book", "left_semi"), large


def cyclic_nodes(pairs: list[tuple[str, str]]) -> set[str]:
    """Nodes on a cycle or between cycles: what is left when sources and sinks are peeled off, one by one."""
    pairs = {p for p in pairs if p[0] != p[1]}
    left = set(pairs)
    for a, b in ((0, 1), (1, 0)):
        after, degree = {}, {}
        for p in left:
            after.setdefault(p[a], []).append(p)
            degree[p[b]] = degree.get(p[b], 0) + 1
        free = [x for x in after if x not in degree]
        while free:
            for p in after.pop(free.pop(), ()):
                left.discard(p)
                degree[p[b]] -= 1
                if not degree[p[b]]:
                    free.append(p[b])
    return {x for p in left for x in p}


def cycle_core(edges: DataFrame) -> DataFrame:
    """(book, node) of nodes that lie on a cycle or between cycles: sources and sinks are peeled off until none is left.

    Books of up to BOOK_EDGES edges are peeled by one worker each; larger ones in rounds over written
    tables, as many as a round still removes an edge.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _table(pdf, node=sorted(cyclic_nodes(list(zip(pdf["src"], pdf["dst"], strict=True)))))

    small, large, _ = _apart(edges.select("book", "src", "dst").filter("src <> dst").distinct())
    found = small.groupBy("book").applyInPandas(peel, f"book {kinds['book']}, node {kinds['src']}")
    return found if large is None else found.union(_nodes(_peeled(large)))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("book", F.col("src").alias("node")).union(edges.select("book", F.col("dst").alias("node"))).distinct()


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges (book, src, dst) whose ends have edges on both sides, once sources and sinks are peeled off until none is left."""
    left = kept(edges, "cycle-edges")
    n, before = left.count(), -1
    while n != before:
        heads, tails = left.select("book", F.col("dst").alias("src")).distinct(), left.select("book", F.col("src").alias("dst")).distinct()
        left = kept(left.join(heads, ["book", "src"], "left_semi").join(tails, ["book", "dst"], "left_semi").select("book", "src", "dst"), "cycle-edges")
        n, before = left.count(), n
    return left


def component_of(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The least name of each node's strongly connected component, by one walk with low links, without recursion."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number, low, out = {}, {}, {}
    open_nodes: list[str] = []
    for root in after:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        open_nodes.append(root)
        walk = [(root, iter(after[root]))]
        while walk:
            node, rest = walk[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    open_nodes.append(nxt)
                    walk.append((nxt, iter(after[nxt])))
                    break
                if nxt not in out:
                    low[node] = min(low[node], number[nxt])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(open_nodes.pop())
                    out |= dict.fromkeys(own, min(own))
    return out


def _coloured(edges: DataFrame) -> DataFrame:
    """(book, node, component) of nodes on cycles, by colouring forward and searching backward over written tables.

    A node's colour is the least name from which it is reached. The nodes of a colour from which that name is reached
    in turn are its component; they go, sources and sinks are peeled off, and what is left is coloured anew.
    """
    found, left = None, _peeled(edges)
    while not left.isEmpty():
        colour = kept(_nodes(left).withColumn("colour", F.col("node")), "colours")
        while True:
            given = left.join(colour.withColumnRenamed("node", "src"), ["book", "src"]).groupBy("book", F.col("dst").alias("node")).agg(F.min("colour").alias("given"))
            new = colour.join(given, ["book", "node"], "left").withColumns({"changed": F.coalesce(F.col("given") < F.col("colour"), F.lit(False)), "colour": F.least("colour", "given")}).drop("given")
            new = kept(new, "colours")
            colour = new.drop("changed")
            if new.filter("changed").isEmpty():
                break
        ends = lambda end: colour.select("book", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = kept(left.join(ends("src"), ["book", "src"]).join(ends("dst"), ["book", "dst"]).filter("src_colour = dst_colour").select("book", "src", "dst"), "colour-edges")
        reached = kept(colour.filter("node = colour"), "reached")
        front = reached
        while not front.isEmpty():
            back = inner.join(front.withColumnRenamed("node", "dst"), ["book", "dst"]).select("book", F.col("src").alias("node"), "colour").distinct()
            front = kept(back.join(reached, ["book", "node"], "left_anti"), "reached-front")
            reached = kept(reached.unionByName(front), "reached")
        own = reached.select("book", "node", F.col("colour").alias("component"))
        found = own if found is None else found.unionByName(own)
        gone = reached.select("book", "node")
        rest = left.join(gone.withColumnRenamed("node", "src"), ["book", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["book", "dst"], "left_anti")
        left = _peeled(rest.select("book", "src", "dst"))
    return left.select("book", F.col("src").alias("node"), F.col("dst").alias("component")) if found is None else found


def strong_components(edges: DataFrame) -> DataFrame:
    """(book, node, component) of every node of ``edges`` (book, src, dst): the least name of those that it reaches and that reach it, itself included.

    Books of up to BOOK_EDGES edges are walked by one worker each, larger ones are coloured in rounds. Loops and repeated edges change nothing.
    """
    own = kept(edges.select("book", "src", "dst").distinct(), "component-edges")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        found = component_of(list(zip(pdf["src"], pdf["dst"], strict=True)))
        return _table(pdf, node=list(found), component=list(found.values()))

    small, large, _ = _apart(own)
    out = small.groupBy("book").applyInPandas(walk, f"book {kinds['book']}, node {kinds['src']}, component {kinds['src']}")
    if large is None:
        return out
    on_cycles = kept(_coloured(large.filter("src <> dst")), "components")
    return out.unionByName(_nodes(large).join(on_cycles, ["book", "node"], "left").withColumn("component", F.coalesce("component", "node")))


def closing_edges(pairs: list[tuple[str, str]], most: int) -> list[tuple[str, str]]:
    """The edges that close the first ``most`` cycles of a depth-first walk, roots and neighbours in order of name."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        after.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    out: list[tuple[str, str]] = []
    for root in sorted({x for p in pairs for x in p}):
        if root in state:
            continue
        state[root] = 1
        walk = [(root, iter(after.get(root, ())))]
        while walk:
            node, rest = walk[-1]
            for nxt in rest:
                if state.get(nxt) == 1:
                    out.append((node, nxt))
                elif nxt not in state:
                    state[nxt] = 1
                    walk.append((nxt, iter(after.get(nxt, ()))))
                    break
            else:
                state[node] = 2
                walk.pop()
    return out[:most]


def break_cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """``edges`` without the ones that close a book's first cycles; only edges of the cyclic core reach the walk."""
    core = cycle_core(edges)
    inner = edges.join(core.withColumnRenamed("node", "src"), ["book", "src"], "left_semi").join(core.withColumnRenamed("node", "dst"), ["book", "dst"], "left_semi")

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        found = closing_edges(list(zip(pdf["src"], pdf["dst"], strict=True)), most)
        return _table(pdf, src=[a for a, _ in found], dst=[b for _, b in found])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    closed = inner.select("book", "src", "dst").groupBy("book").applyInPandas(close, f"book {kinds['book']}, src {kinds['src']}, dst {kinds['dst']}")
    return edges.join(closed, ["book", "src", "dst"], "left_anti")


def longest_paths(pairs: list[tuple[str, str, bool]]) -> dict[str, int]:
    """Tier of each node that an edge (src, dst, known) ends at; an unknown source is of tier 0 whatever leads to it."""
    degree, after, tier = {}, {}, {}
    for a, b, known in pairs:
        tier[b] = 1
        if known:
            after.setdefault(a, []).append(b)
            degree[b] = degree.get(b, 0) + 1
    free = [x for x in {*after, *tier} if not degree.get(x)]
    done = 0
    while free:
        x = free.pop()
        done += 1
        for y in after.get(x, ()):
            tier[y] = max(tier[y], tier.get(x, 0) + 1)
            degree[y] -= 1
            if not degree[y]:
                free.append(y)
    if done < len({*after, *tier}):
        raise ValueError("the edges have a cycle")
    return tier


def tiers(concepts: DataFrame, edges: DataFrame, order: str | None = None) -> DataFrame:
    """(book, concept, tier): the longest path from a concept without prerequisites; unknown prerequisites count as tier 0.

    ``edges`` with a cycle are an error, unless ``order`` names a column of ``concepts``: a prerequisite that
    does not come before its concept in that order counts as an unknown one. Books of up to BOOK_EDGES edges are walked by one worker each;
    larger ones by one relaxation a round over written tables, until nothing changes.
    """
    names = concepts.select("book", "concept").distinct()
    known = names.select("book", F.col("concept").alias("src"), F.lit(True).alias("known"))
    by = edges.select("book", "src", "dst").distinct().join(names.withColumnRenamed("concept", "dst"), ["book", "dst"], "left_semi")
    if order is not None:
        place = lambda end: concepts.groupBy("book", F.col("concept").alias(end)).agg(F.min(order).alias(f"{end}_place"))
        by = by.join(place("src"), ["book", "src"], "left").join(place("dst"), ["book", "dst"])
        # A name of its own makes the prerequisite unknown.
        late = F.coalesce(F.col("src_place") >= F.col("dst_place"), F.lit(False))
        by = by.select("book", F.when(late, F.concat(F.lit("\0"), "src")).otherwise(F.col("src")).alias("src"), "dst")
    small, large, books = _apart(by)
    kinds = {f.name: f.dataType.simpleString() for f in concepts.schema}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        found = longest_paths(list(zip(pdf["src"], pdf["dst"], pdf["known"], strict=True)))
        return _table(pdf, concept=list(found), tier=list(found.values()))

    rows = small.join(known, ["book", "src"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    up = rows.groupBy("book").applyInPandas(walk, f"book {kinds['book']}, concept {kinds['concept']}, tier int")
    if large is not None:
        up = up.unionByName(_relaxed(concepts.join(books, "book", "left_semi"), large))
    return concepts.select("book", "concept").join(up, ["book", "concept"], "left").select("book", "concept", F.coalesce("tier", F.lit(0)).alias("tier"))


def _relaxed(concepts: DataFrame, by: DataFrame) -> DataFrame:
    """(book, concept, tier): one relaxation of all edges a round, until nothing changes."""
    by = kept(by, "tier-edges")
    now = kept(concepts.select("book", "concept").distinct().withColumn("tier", F.lit(0)), "tiers")
    most = now.groupBy("book").count().agg(F.max("count")).first()[0] or 0
    total, last, rounds = 0, -1, 0
    while total != last:
        if rounds > most:  # no path is longer than a book's concepts
            raise ValueError("the edges have a cycle")
        given = now.withColumnRenamed("concept", "src")
        up = by.join(given, ["book", "src"], "left").groupBy("book", F.col("dst").alias("concept")).agg((F.max(F.coalesce("tier", F.lit(0))) + 1).alias("up"))
        now = kept(now.select("book", "concept").join(up, ["book", "concept"], "left").select("book", "concept", F.coalesce("up", F.lit(0)).alias("tier")), "tiers")
        total, last, rounds = now.agg(F.sum("tier")).first()[0], total, rounds + 1
    return now


def order_violations(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """(book, src, dst): edges whose source does not come before its target."""
    a, b = positions.select("book", F.col("concept").alias("src"), F.col("position").alias("p")), positions.select("book", F.col("concept").alias("dst"), F.col("position").alias("q"))
    return edges.join(a, ["book", "src"]).join(b, ["book", "dst"]).filter("p >= q").select("book", "src", "dst")


def _by(concepts: DataFrame, edges: DataFrame, *order: str) -> DataFrame:
    """(book, concept, position) in the order of columns, then ord; a book with a cycle keeps its order by ord."""
    cyclic = kept(cycle_core(edges).select("book").distinct(), "cyclic-books")
    level = tiers(concepts, edges.join(cyclic, "book", "left_anti"))
    rows = concepts.join(level, ["book", "concept"]).join(cyclic.withColumn("cyclic", F.lit(True)), "book", "left")
    keys = [F.when(F.col("cyclic").isNull(), F.col(c)) for c in order]
    return rows.select("book", "concept", F.row_number().over(W.partitionBy("book").orderBy(*keys, "ord")).alias("position"))


def topological_order(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(book, concept, position): by tier, then ord; a book whose edges have a cycle keeps its order by ord."""
    return _by(concepts, edges, "tier")


def grouped_order(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(book, concept, position): by tier, then cluster, then ord; concepts have book, concept, cluster and ord.

    Books without edges, and books whose edges have a cycle, keep their order by ord.
    """
    some = edges.select("book", F.lit(True).alias("some")).distinct()
    linked = concepts.join(some, "book", "left").withColumn("cluster", F.when(F.col("some"), F.coalesce("cluster", F.lit("unknown")))).drop("some")
    return _by(linked, edges, "tier", "cluster")


def neighbours(members: DataFrame, edges: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(book, number, concept, role, other): descriptions of prerequisites and, for edges that end outside the session, dependents."""
    here = members.select("book", "number", "concept")
    into = edges.join(here.withColumnRenamed("concept", "dst"), ["book", "dst"]).select("book", "number", F.col("dst").alias("concept"), F.lit("prerequisite").alias("role"), F.col("src").alias("name"))
    out = edges.join(here.withColumnRenamed("concept", "src"), ["book", "src"])
    out = out.join(here.withColumnRenamed("concept", "dst"), ["book", "number", "dst"], "left_anti").select("book", "number", F.col("src").alias("concept"), F.lit("dependent").alias("role"), F.col("dst").alias("name"))
    text = descriptions.select("book", F.col("concept").alias("name"), "description")
    return into.unionByName(out).join(text, ["book", "name"], "left").select("book", "number", "concept", "role", F.coalesce("description", "name").alias("other"))
