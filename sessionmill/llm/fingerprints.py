"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL expressions.

A paragraph is a non-empty line; a text's paragraphs are a set. Each digest goes into one cell of each of ``PARTS`` parts of ``WIDE``
cells; a cell has the number of its digests and the exclusive or of them and of their checks. The sketches of two versions
subtract cell by cell: what both have cancels out. Peeling takes a cell that holds one digest, notes it, removes it from its other
cells and goes on until all cells are empty. Where peeling stops before, the pair's digests are dealt to several sketches of
the same size by their check, and each that still fails to four times as many, until all differing digests are recovered.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import global_rank
from .common import keep, shared_dir, whole_text

PARTS, WIDE, FIELD = 3, 12, 20      # parts of a sketch, cells of a part, bits of the digest that choose a part's cell
CELLS = PARTS * WIDE
ROUNDS = 12                         # peeling steps; each takes all cells that hold one digest
SHARE = 6                           # digests for each sketch on a retry
PRIME_A, FACTOR, PRIME_B = 2147483647, 1000003, 4294967291   # of the check

_MASK = (1 << FIELD) - 1


def check(k: str) -> str:
    return f"({k} % {PRIME_A}L) * {FACTOR}L % {PRIME_B}L"


def in_cell(k: str, i: str) -> str:
    """Whether digest k belongs to cell number i."""
    return f"(shiftright({k}, {FIELD} * cast({i} div {WIDE} as int)) & {_MASK}L) % {WIDE} = {i} % {WIDE}"


def paragraphs(text: str | Column) -> Column:
    """Digests of the distinct non-empty lines: the first 60 bits of their MD5."""
    lines = F.array_distinct(F.filter(F.split(text, "\n"), lambda p: p != ""))
    return F.transform(lines, lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("bigint"))


def sketch(digests: str) -> Column:
    """Cells of a set of digests (column name)."""
    return F.expr(f"""transform(transform(sequence(0, {CELLS - 1}), i -> filter({digests}, k -> {in_cell('k', 'i')})), m -> named_struct(
        'n', size(m), 'k', aggregate(m, 0L, (a, k) -> a ^ k), 'c', aggregate(m, 0L, (a, k) -> a ^ ({check('k')}))))""")


def subtract(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))")


def peel(cells: str) -> Column:
    """(cells, found): what is left of a difference, and the recovered (k, n), n = 1 where only the first side has k, else -1."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 AND x.c = {check('x.k')}), x -> named_struct('k', x.k, 'n', x.n)))"
    less = f"""transform(transform(s.cells, (x, i) -> named_struct('x', x, 'm', filter(s.pure, p -> {in_cell('p.k', 'i')}))), y -> named_struct(
        'n', y.x.n - aggregate(y.m, 0, (a, p) -> a + p.n), 'k', aggregate(y.m, y.x.k, (a, p) -> a ^ p.k),
        'c', aggregate(y.m, y.x.c, (a, p) -> a ^ ({check('p.k')}))))"""
    found = "concat(s.found, s.pure)"
    none = f"filter(transform({cells}, x -> named_struct('k', x.k, 'n', x.n)), x -> false)"
    start = f"named_struct('cells', {cells}, 'found', {none}, 'pure', {pure.replace('s.cells', cells)})"
    step = f"""if(size(s.pure) = 0, s, transform(array(named_struct('cells', {less}, 'found', {found})), s -> named_struct(
        'cells', s.cells, 'found', s.found, 'pure', {pure}))[0])"""
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> named_struct('cells', s.cells, 'found', s.found))")


def decoded(peeled: str) -> Column:
    """The recovered digests, null if cells are left."""
    return F.expr(f"if(exists({peeled}.cells, x -> x.n <> 0 OR x.k <> 0 OR x.c <> 0), NULL, {peeled}.found)")


def written(cells: str) -> Column:
    """A sketch as text: number, digests and checks of each cell in hexadecimal."""
    return F.expr(f"array_join(transform({cells}, x -> concat_ws('.', lower(hex(x.n)), lower(hex(x.k)), lower(hex(x.c)))), ',')")


def difference(pairs: DataFrame) -> DataFrame:
    """``id``, ``found`` for each row of ``pairs`` (``id``, digest sets ``a`` and ``b``; a stored table with distinct ids).

    One sketch of fixed size for each side first; rows that cannot be peeled are dealt to more sketches, of about ``SHARE`` digests each,
    as rows of their own, so that a text of very many paragraphs is spread over tasks; again until none fails.
    """
    tried = keep(pairs.withColumn("d", subtract_of("a", "b")).withColumn("p", peel("d")).select("id", decoded("p").alias("found")), "peeled")
    done, failed = [tried.filter("found IS NOT NULL")], tried.filter("found IS NULL").select("id")
    many = F.greatest(F.lit(4), F.ceil((F.size("a") + F.size("b")) / SHARE)).cast("bigint")
    side = lambda c, n: F.transform(c, lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))
    left = pairs.join(failed, "id", "left_semi").select("id", many.alias("many"), F.explode(F.concat(side("a", 1), side("b", -1))).alias("e"))
    left = left.select("id", "many", F.expr(check("e.k")).alias("c"), "e.k", "e.n")
    while not left.isEmpty():
        dealt = left.groupBy("id", "many", (F.col("c") % F.col("many")).alias("part")).agg(
            F.collect_list(F.when(F.col("n") == 1, F.col("k"))).alias("a"), F.collect_list(F.when(F.col("n") == -1, F.col("k"))).alias("b"))
        tried = keep(dealt.withColumn("d", subtract_of("a", "b")).withColumn("p", peel("d")).withColumn("found", decoded("p")).drop("d", "p"), "peeled")
        done.append(tried.filter("found IS NOT NULL").select("id", "found"))
        more = tried.filter("found IS NULL").select("id", (F.col("many") * 4).alias("many"), F.explode(F.concat(side("a", 1), side("b", -1))).alias("e"))
        left = more.select("id", "many", F.expr(check("e.k")).alias("c"), "e.k", "e.n")
    return reduce(DataFrame.unionByName, done)


def subtract_of(a: str, b: str) -> Column:
    """The subtracted sketches of two digest columns."""
    cells = "filter({d}, k -> {c})"
    return F.expr(f"""transform(transform(sequence(0, {CELLS - 1}), i -> named_struct(
        'x', {cells.format(d=a, c=in_cell('k', 'i'))}, 'y', {cells.format(d=b, c=in_cell('k', 'i'))})), m -> named_struct(
        'n', size(m.x) - size(m.y), 'k', aggregate(m.y, aggregate(m.x, 0L, (a, k) -> a ^ k), (a, k) -> a ^ k),
        'c', aggregate(m.y, aggregate(m.x, 0L, (a, k) -> a ^ ({check('k')})), (a, k) -> a ^ ({check('k')}))))""")


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Common share of all paragraphs, from the sizes and the number of differing digests; 1 if neither side has any."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differing).cast("double") / (n_a + n_b + differing).cast("double"))


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``ks`` and ``kn`` (the key as text, and whether it is null), ``h`` (hash of the text), ``k`` and ``t``."""
    k = F.col(f"`{key}`")
    return docs.select(F.coalesce(k.cast("string"), F.lit("")).alias("ks"), k.isNull().alias("kn"), F.xxhash64(whole_text(F.col(f"`{text}`"))).alias("h"), k.alias("k"),
                       whole_text(F.col(f"`{text}`")).alias("t"))


def order_of(rows: DataFrame) -> DataFrame:
    """``ks``, ``kn``, ``h``, ``k``, ``n``, ``copies`` and ``pks``, ``pkn``, ``ph``, ``need``: the distinct (key, hash of text), with the one before
    (the last of all before the first) by ascending key, null first, then hash, and half that document's length, which it takes from
    this one."""
    ids = rows.groupBy("ks", "kn", "h").agg(F.min("k").alias("k"), F.max(F.length("t")).cast("bigint").alias("n"), F.count(F.lit(1)).alias("copies"))
    shared_dir(rows.sparkSession)
    ranked = keep(global_rank(ids, [F.col("k").asc_nulls_first(), F.col("h").asc()]), "order")
    last = ranked.agg(F.max("rank")).first()[0]
    prior = ranked.select(F.when(F.col("rank") == last, F.lit(1)).otherwise(F.col("rank") + 1).cast("bigint").alias("rank"),
                          F.col("ks").alias("pks"), F.col("kn").alias("pkn"), F.col("h").alias("ph"), F.expr("n div 2").alias("need"))
    return ranked.join(prior, "rank").drop("rank")


def with_edits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k``, ``copies``, ``n``, ``edited_sha256`` (binary) and the digest sets ``own``, ``edited``, ``next`` of each distinct (key, text).

    Texts are exchanged once, by key and hash, where repeated rows are one already; each then sends the start that the document
    before needs to where that one lies.
    """
    rows, at = named(docs, key, text), ["ks", "kn", "h"]
    texts = rows.groupBy(*at).agg(F.any_value("t").alias("t"))
    placed = texts.join(order_of(rows), at)
    own = placed.select(*at, "k", "copies", "n", F.expr("left(t, cast(n - n div 2 as int))").alias("t"), paragraphs("t").alias("own"))
    given = placed.select(F.col("pks").alias("ks"), F.col("pkn").alias("kn"), F.col("ph").alias("h"), F.expr("left(t, cast(need as int))").alias("start"), paragraphs("t").alias("next"))
    edited = own.join(given, at).withColumn("t", F.concat("t", "start"))
    return edited.select("k", "copies", "n", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("edited_sha256"), "own", paragraphs("t").alias("edited"), "next")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``: a row for each row.

    Null and empty texts have no paragraphs and an empty sketch. Rows of equal key are in the order of their texts' hashes; rows equal in both
    count once in that order and each give a row. A table of one document is its own next. An empty table gives no rows.
    """
    rows = keep(with_edits(docs, key, text).withColumn("id", F.monotonically_increasing_id()), "edits")
    pairs = rows.select((F.col("id") * 2).alias("id"), F.col("own").alias("a"), F.col("edited").alias("b")).unionByName(
        rows.select((F.col("id") * 2 + 1).alias("id"), F.col("own").alias("a"), F.col("next").alias("b")))
    apart = difference(pairs).groupBy(F.expr("id div 2").alias("id")).agg(
        F.sum(F.when(F.col("id") % 2 == 0, F.size("found"))).alias("d_edited"), F.sum(F.when(F.col("id") % 2 == 1, F.size("found"))).alias("d_next"))
    narrow = rows.select("id", "k", "copies", "n", "edited_sha256", "own", "edited", F.size("next").alias("n_next"))
    out = narrow.join(apart, "id").withColumn("s", sketch("own")).withColumn("e", sketch("edited"))
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_chars"), F.lower(F.hex("edited_sha256")).alias("edited_sha256"), written("s").alias("fingerprint"),
                      written("e").alias("edited_fingerprint"), likeness(F.size("own"), F.size("edited"), F.col("d_edited")).alias("near_edited"),
                      likeness(F.size("own"), F.col("n_next"), F.col("d_next")).alias("near_next"))
