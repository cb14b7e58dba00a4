"""Reading log files (SC01-SC04, SC07-SC10, SC12, SC13, SC16)."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions import times
from ..functions import variants as V
from ..functions.ids import stable_id
from ..operators.ordered import running
from . import trees

DOCUMENT_BYTES = 256 << 20   # documents above this are read in pieces; their rows are the same


def roots(spark: SparkSession, paths: list[str], found: DataFrame | None = None) -> list[str]:
    """The paths and every folder below them whose name begins with ``.`` or ``_``: Spark's listing passes those over unless they
    are named. What is inside such a folder is found by Spark, folders hidden in it are named themselves, so none comes twice.
    ``found`` is ``trees.tree`` of the paths; the names of hidden folders are all that reaches the driver."""
    found = trees.tree(spark, paths) if found is None else found
    # a folder that was named by the caller is there already
    named = {trees.plain(p) for p in paths}
    return list(paths) + sorted(r.path for r in found.filter("folder AND error IS NULL").filter(trees.hidden()).select("path").collect() if r.path not in named)


def _unlinked(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows of files that Spark's reader did not reach through a symbolic link; their names pass the driver."""
    for r in found.filter(F.col("error") == trees.LINK).select("path").collect() if found is not None else ():
        rows = rows.filter((F.col("path") != r.path) & ~F.startswith("path", F.lit(r.path + "/")))
    return rows


def _reader(spark: SparkSession, **options: str):
    r = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    for k, v in options.items():
        r = r.option(k, v)
    return r


def _path(c: Column) -> Column:
    """Plain path of a file URI."""
    return F.url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "^file:(?://)?(?=/)", ""))


def _file_columns() -> list[Column]:
    return [_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("size_bytes"),
            F.unix_millis("_metadata.file_modification_time").alias("mtime_ms")]


def _named(glob: str | None) -> Column:
    """The file's name fits a pattern of names."""
    return F.lit(True) if glob is None else F.element_at(F.split("path", "/"), -1).rlike(f"^{glob_regex(glob)}$")


def log_files(spark: SparkSession, paths: list[str], host: str = "", glob: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row per file from the listing alone, contents are not read (SC07); hidden ones and those in hidden folders are files like any.
    ``found`` is ``trees.tree`` of the paths where it is there already; folders in it that could not be read have an ``error``."""
    found = trees.tree(spark, paths) if found is None else found
    files = trees.files_of(found).filter(_named(glob)).select("path", "size_bytes", "mtime_ms")
    return files.withColumn("trace_id", stable_id(F.col("path"), F.lit(host)))


def _must_exist(spark: SparkSession, paths: list[str]) -> None:
    """Paths that are not there are an error, as they are to Spark's reader."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
            _reader(spark).format("text").load(path)


def _near_and_far(found: DataFrame, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that tasks read whole, and those left to Spark's reader: large and packed ones. Hidden names are in neither."""
    seen, small = trees.files_of(found).filter(~trees.hidden()).filter(_named(glob)), (F.col("size_bytes") <= trees.SMALL) & ~trees.packed()
    return seen.filter(small), seen.filter(~small)


def _far_rows(spark: SparkSession, paths: list[str], found: DataFrame, far: DataFrame, columns: list[Column], **options: str) -> DataFrame:
    """What Spark's reader gives for the files left to it; the condition on the file's size keeps it from opening the others."""
    raw = _reader(spark, **options).format("text").load(roots(spark, paths, found))
    raw = raw.filter((F.col("_metadata.file_size") > trees.SMALL) | trees.packed("_metadata.file_path")).select(*_file_columns(), *columns)
    return _unlinked(raw, found).join(far.select("path"), "path", "left_semi")


def _texts(spark: SparkSession, paths: list[str], found: DataFrame, glob: str | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ms, text) of whole files with names that Spark's listing gives: small ones opened by tasks."""
    _must_exist(spark, paths)
    near, far = _near_and_far(found, glob)
    rows = trees.read_texts(near)
    return rows if far.isEmpty() else rows.unionByName(_far_rows(spark, paths, found, far, [F.col("value").alias("text")], wholetext="true").select(*rows.columns))


def lines(spark: SparkSession, paths: list[str], host: str = "", found: DataFrame | None = None) -> DataFrame:
    """(trace_id, path, mtime_ms, row_no, offset, line) of text files of any size.

    Small files are read whole by tasks. Large ones are split as usual: the place of a line is its place inside its split plus the line and
    character counts of the splits before, which are folded to one row per split. Files whose names Spark's readers pass over are read by tasks.
    """
    found = trees.tree(spark, paths) if found is None else found
    _must_exist(spark, paths)
    near, far = _near_and_far(found)
    columns = ["path", "size_bytes", "mtime_ms", "row_no", "offset", "line"]
    rows = trees.read_small_lines(near).select(*columns)
    if not far.isEmpty():
        raw = _far_rows(spark, paths, found, far, [F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"),
                                                   F.monotonically_increasing_id().alias("pos")], lineSep="\n")
        placed = running(raw, ["path"], "pos", {"row_no": ("count", None), "past": ("sum", F.length("line") + 1)}, chunk=F.col("block"))
        rows = rows.unionByName(placed.withColumn("offset", F.col("past") - F.length("line") - 1).select(*columns))
    dark = trees.files_of(found).filter(trees.hidden())
    if not dark.isEmpty():
        rows = rows.unionByName(trees.read_lines(dark).select(*columns))
    return rows.select(stable_id(F.col("path"), F.lit(host)).alias("trace_id"), *columns)


def json_rows(line_rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as text and variant; everything else is skipped (SC01)."""
    trimmed = line_rows.withColumn("raw_json", X.strip(F.col("line"))).drop("line").filter("raw_json <> ''")
    return trimmed.withColumn("v", F.try_parse_json("raw_json")).filter(F.col("raw_json").startswith("{") & F.col("v").isNotNull())


def documents(spark: SparkSession, paths: list[str], host: str = "", glob: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Whole files as one text each, however they are laid out inside."""
    found = trees.tree(spark, paths) if found is None else found
    return _texts(spark, paths, found, glob).withColumn("trace_id", stable_id(F.col("path"), F.lit(host)))


def is_document(text: Column) -> Column:
    """The whole text is one JSON object or array. Parsers stop after a first value, so the text is read as the only item of a list."""
    only = V.items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$")
    return F.coalesce((F.size(only) == 1) & (V.is_object(F.get(only, F.lit(0))) | V.is_array(F.get(only, F.lit(0)))), F.lit(False))


def document_rows(docs: DataFrame) -> DataFrame:
    """Message rows of whole-document sessions (SC02).

    An object with messages gives its messages, another object itself, an array its objects. Text that is no JSON gives
    no row here and is left to the line reader (``is_document``). ``doc_session_id`` is the document's own id, '' when it has none.
    """
    doc = docs.filter(is_document(F.col("text"))).withColumn("doc", F.try_parse_json("text"))
    d = F.col("doc")
    messages = F.size(V.items(d, "$.messages")) > 0
    values = (F.when(messages, V.items(d, "$.messages")).when(V.is_object(d), F.array(d))
              .when(V.is_array(d), V.items(d, "$")))
    texts = (F.when(messages, V.item_texts(F.col("text"), "$.messages")).when(V.is_object(d), F.array("text"))
             .when(V.is_array(d), F.from_json("text", "array<string>")))
    flat = doc.withColumn("values", values).withColumn("texts", texts).withColumn(
        "doc_session_id", F.when(V.is_object(d), V.first_text(d, "$.sessionId", "$.session_id"))
        .otherwise(V.first_text(d, "$[0].sessionId", "$[0].session_id")))
    pairs = F.transform("values", lambda x, i: F.struct(x.alias("v"), F.get("texts", i).alias("j"), V.is_object(x).alias("o")))
    keep = F.filter(pairs, lambda p: ~V.is_array(d) | (p["o"] & (F.to_json(p["v"]) != "{}")))
    rows = flat.select("trace_id", "path", "size_bytes", "mtime_ms", "doc_session_id", F.posexplode(keep).alias("row_no", "p"))
    as_object = F.when(F.col("p.o"), F.col("p.v")).otherwise(F.parse_json(F.lit("{}")))
    return rows.select("trace_id", "path", "size_bytes", "mtime_ms", "doc_session_id", F.col("row_no").cast("bigint").alias("row_no"),
                       (F.col("row_no").cast("bigint") * 1000).alias("offset"), F.col("p.j").alias("raw_json"),
                       as_object.alias("v"))


def document_file_rows(spark: SparkSession, paths: list[str], host: str = "", glob: str | None = None, found: DataFrame | None = None,
                       large: int = DOCUMENT_BYTES) -> DataFrame:
    """``document_rows`` of the documents among the files below the paths, of any size and name (SC02): those of up to ``large`` bytes as one
    text each, larger and hidden ones read in pieces by tasks. Both give the same rows."""
    found = trees.tree(spark, paths) if found is None else found
    few = found.filter(F.col("folder") | (F.col("size_bytes") <= large))
    rows, apart = document_rows(documents(spark, paths, host, glob, few).filter(F.col("size_bytes") <= large)), apart_documents(found, host, glob, large)
    return rows if apart.isEmpty() else rows.unionByName(trees.read_documents(apart))


def apart_documents(found: DataFrame, host: str = "", glob: str | None = None, large: int = DOCUMENT_BYTES) -> DataFrame:
    """The files that Spark's reader would pass over or make too large a row of, for ``trees.read_documents``."""
    files = trees.files_of(found).filter(_named(glob)).filter(trees.hidden() | (F.col("size_bytes") > large))
    return files.select(stable_id(F.col("path"), F.lit(host)).alias("trace_id"), "path", "size_bytes", "mtime_ms")


def role_blocks(line_rows: DataFrame) -> DataFrame:
    """Lines of a role-headed transcript with role, block number and place inside the block (SC03).

    Lines before the first header belong to no block and are dropped; blocks keep their lines as rows.
    """
    head = F.regexp_extract("line", r"(?i)^(user|assistant):\s*$", 1)
    df = line_rows.withColumn("head", F.lower(head))
    is_head = F.col("head") != ""
    after = F.col("offset") + F.length("line") + 1
    carried = running(df, ["trace_id"], "row_no", {
        "block_no": ("sum", F.when(is_head, 1).otherwise(0)), "role": ("last", F.when(is_head, F.col("head"))),
        "block_offset": ("last", F.when(is_head, after)), "head_row": ("last", F.when(is_head, F.col("row_no")))})
    body = carried.filter((F.col("block_no") > 0) & (F.col("head") == ""))
    return body.drop("head")


def entities(spark: SparkSession, root: str, kind: str, glob: str = "*.json") -> DataFrame:
    """Session, message or part files of a multi-file source (SC04): (key, owner, path, raw_json, v).

    ``owner`` is the directory name (project, session or message id), ``key`` the file name without extension.
    """
    paths = [f"{root}/storage/{kind}"]
    found = trees.tree(spark, paths)
    docs, path = _texts(spark, paths, found, glob).withColumnRenamed("text", "value"), F.col("path")
    # links are followed here
    if linked := [r.path for r in found.filter(F.col("error") == trees.LINK).filter(~trees.hidden()).select("path").collect()]:
        docs = docs.unionByName(_reader(spark, wholetext="true", pathGlobFilter=glob).format("text").load(linked).select(*_file_columns(), "value"))
    return (docs.select(X.basename_stem(path).alias("key"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("owner"),
                        "path", "size_bytes", "mtime_ms", F.col("value").alias("raw_json"),
                        F.try_parse_json("value").alias("v")).filter(V.is_object(F.col("v"))))


# ---- which files belong to a source -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Profile:
    """A named source: roots, wanted and unwanted globs, largest depth below the root, agent of its files (UX03)."""
    name: str
    roots: tuple[str, ...]
    agent: str = "unknown"
    include: tuple[str, ...] = ("**/*.jsonl",)
    exclude: tuple[str, ...] = ()
    max_depth: int = 8
    enabled: bool = True


@dataclass(frozen=True)
class LogDirectory:
    directory: str
    agent: str


# Default sources.
DEFAULT_DIRECTORIES = (
    LogDirectory("~/.codex", "codex"), LogDirectory("~/.claude", "claude"), LogDirectory("~/.cursor", "cursor"),
    LogDirectory("~/.gemini", "gemini"), LogDirectory("~/.pi", "pi"),
    LogDirectory("~/.local/share/opencode", "opencode"))
DEFAULT_PROFILES = (
    Profile("codex_home", ("~/.codex/sessions",), "codex"),
    Profile("claude_projects", ("~/.claude/projects",), "claude", exclude=("**/subagents/agent-acompact-*.jsonl",)),
    Profile("claude_history", ("~/.claude",), "claude", ("history.jsonl",), max_depth=2),
    Profile("cursor_agent_transcripts", ("~/.cursor/projects",), "cursor",
            ("**/agent-transcripts/*.txt", "**/agent-transcripts/*.jsonl")),
    Profile("opencode_storage_session", ("~/.local/share/opencode/storage/session",), "opencode", ("**/*.json",)),
    Profile("gemini_tmp", ("~/.gemini/tmp",), "gemini", ("**/chats/session-*.json", "**/*.jsonl")),
    Profile("pi_agent_sessions", ("~/.pi/agent/sessions",), "pi"))

# Path segments a root may already contain, and the globs that then remain; '' is the default.
CONVENTIONS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "codex": (("sessions", ("**/*.jsonl",)), ("", ("sessions/**/*.jsonl",))),
    "claude": (("projects", ("**/*.jsonl",)), ("", ("projects/**/*.jsonl",))),
    "cursor": (("agent-transcripts", ("**/*.txt", "**/*.jsonl")),
               ("projects", ("**/agent-transcripts/*.txt", "**/agent-transcripts/*.jsonl")),
               ("", ("projects/**/agent-transcripts/*.txt", "projects/**/agent-transcripts/*.jsonl"))),
    "gemini": (("chats", ("**/session-*.json", "**/*.jsonl")), ("tmp", ("**/chats/session-*.json", "**/*.jsonl")),
               ("", ("tmp/**/chats/session-*.json", "tmp/**/*.jsonl"))),
    "opencode": (("session", ("**/*.json",)), ("storage", ("session/**/*.json",)), ("", ("storage/session/**/*.json",))),
    "pi": (("sessions", ("**/*.jsonl",)), ("agent", ("sessions/**/*.jsonl",)), ("", ("agent/sessions/**/*.jsonl",))),
}


def convention_globs(root: str, agent: str) -> tuple[str, ...]:
    """Globs below a session directory of an agent, given what the root's path already contains (SC08)."""
    parts = {p.lower() for p in root.replace("\\", "/").split("/")}
    for segment, globs in CONVENTIONS.get(agent, (("", ("**/*.jsonl",)),)):
        if segment == "" or (segment in parts and (agent != "opencode" or segment == "storage" or "storage" in parts)):
            return globs
    return ("**/*.jsonl",)


def glob_regex(glob: str) -> str:
    """Regular expression of a glob relative to a root, without anchors."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|?\\" else glob[i]), i + 1
    return out


def under_root(path: Column, root: str, include: tuple[str, ...], exclude: tuple[str, ...] = (), depth: int = 8) -> Column:
    """The path is below the root, wanted, not excluded and not too deep: one expression match per path."""
    base = glob_regex(root.rstrip("/") + "/")
    any_of = lambda globs: "(?:" + "|".join(glob_regex(g) for g in globs) + ")"
    unwanted = f"(?!{any_of(exclude)}$)" if exclude else ""
    return path.rlike(f"^{base}(?=(?:[^/]+/){{0,{depth - 1}}}[^/]+$){unwanted}{any_of(include)}$")


def is_compaction_side_chain(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.contains("/subagents/") & p.rlike(r"/agent-acompact-[^/]+\.jsonl$")


def _source(name: Column | str, agent: str, hint: str | None, order: int) -> Column:
    return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("source_profile"), F.lit(agent).alias("agent_hint"),
                    F.lit(hint).alias("parser_hint"))


def discover(files: DataFrame, directories=DEFAULT_DIRECTORIES, profiles=DEFAULT_PROFILES, home: str = "~") -> DataFrame:
    """Files that belong to a source, each once: log directories before profiles, profiles by name (SC10, ST01).

    ``files`` has path, trace_id, mtime_ms. Sources are parameters, so this is one projection, no join.
    """
    full = lambda r: home + r[1:] if r.startswith("~") else r
    path = F.col("path")
    hits = []
    for i, d in enumerate(directories):
        root = full(d.directory)
        include = convention_globs(root, d.agent)
        if d.agent == "opencode":
            include = include + tuple(g.replace("session/", "session_diff/", 1) for g in include if "session/" in g)
        ok = under_root(path, root, include, (), 12)
        if d.agent == "claude":
            ok = ok & ~is_compaction_side_chain(path)
        hits.append(F.when(ok, _source("session_log", d.agent, d.agent, i)))
    for i, p in enumerate(sorted((p for p in profiles if p.enabled), key=lambda p: p.name)):
        for r in p.roots:
            hits.append(F.when(under_root(path, full(r), p.include, p.exclude, p.max_depth),
                               _source(p.name, p.agent, None, 1000 + i)))
    best = files.withColumn("src", F.coalesce(*hits))
    cols = [c for c in files.columns if c != "trace_id"]
    place = F.when(F.col("src").isNotNull(), F.struct(F.col("src.ord"), path))
    one = best.groupBy("trace_id").agg(F.min_by(F.struct(*cols, "src"), place).alias("f")).filter("f IS NOT NULL")
    return one.select("trace_id", *[F.col(f"f.{c}").alias(c) for c in cols], "f.src.source_profile",
                      "f.src.agent_hint", "f.src.parser_hint")


def without_superseded_diffs(files: DataFrame) -> DataFrame:
    """Drops diff placeholders of sessions that have a session file (JN06)."""
    key, is_diff = X.basename_stem(F.col("path")), F.lower("path").contains("/session_diff/")
    diffs = files.filter(is_diff).withColumn("__k", key).filter("__k <> ''")
    have = files.filter(~is_diff & F.lower("path").contains("/session/")).select(key.alias("__k")).distinct()
    return files.filter(~is_diff).unionByName(diffs.join(have, "__k", "left_anti").drop("__k"))


# Path parts a file of a log directory must have, per agent.
REQUIRED_PARTS = {"codex": ("/sessions/",), "claude": ("/projects/",), "cursor": ("/projects/", "/agent-transcripts/"),
                  "pi": ("/agent/sessions/",)}


def attribution(path: Column, directories=DEFAULT_DIRECTORIES, profiles=DEFAULT_PROFILES, home: str = "~") -> Column:
    """Source struct of a single path, null if no source owns it or its extension does not fit the agent (SC12)."""
    full = lambda r: (home + r[1:] if r.startswith("~") else r).lower()
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    below = lambda r: (p == full(r)) | p.startswith(full(r).rstrip("/") + "/")
    hits = []
    for i, d in enumerate(directories):
        ok = below(d.directory)
        for part in REQUIRED_PARTS.get(d.agent, ()):
            ok = ok & p.contains(part)
        if d.agent == "opencode":
            ok = ok & p.rlike("/storage/session(_diff)?/")
        hits.append(F.when(ok, _source("session_log", d.agent, d.agent, i)))
    for i, pr in enumerate(sorted((x for x in profiles if x.enabled), key=lambda x: x.name)):
        for r in pr.roots:
            hits.append(F.when(below(r), _source(pr.name, pr.agent, None if pr.agent == "unknown" else pr.agent, 1000 + i)))
    src = F.coalesce(*hits)
    agent = src["agent_hint"]
    jsonl = p.endswith(".jsonl")
    fits = (F.when(agent == "opencode", p.endswith(".json")).when(agent == "cursor", jsonl | p.endswith(".txt"))
            .when(agent == "gemini", jsonl | p.rlike(r"/tmp/[^/]+/chats/session-[^/]+\.json$"))
            .when(agent == "pi", jsonl & p.contains("/agent/sessions/")).otherwise(jsonl))
    return F.when(fits, src)


def coverage(files: DataFrame, processed: DataFrame, window_start_ms: int) -> DataFrame:
    """How many of the files that matter for a window are processed (SC16)."""
    done = processed.select("trace_id", F.lit(True).alias("done")).distinct()
    both = files.filter(F.col("mtime_ms") >= window_start_ms).join(done, "trace_id", "left")
    agg = both.agg(F.count(F.lit(1)).alias("relevant"), F.count_if("done").alias("processed"))
    pct = F.when(F.col("relevant") == 0, 100).otherwise(F.floor(F.col("processed") / F.col("relevant") * 100 + 0.5))
    return agg.withColumn("percent", pct.cast("bigint")).withColumn("ready", F.col("processed") >= F.col("relevant"))


def ingest_errors(files: DataFrame, rows: DataFrame, message: str = "no parseable rows") -> DataFrame:
    """Adds ``parse_error`` to the file listing: '' or why a file gave no rows. Never fails the job (SC14)."""
    n = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("__n"))
    err = F.when(F.coalesce(F.col("__n"), F.lit(0)) > 0, "").otherwise(message)
    return files.join(n, "trace_id", "left").withColumn("parse_error", err).drop("__n")


def write_jsonl(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Events as JSON lines, one object per row (SC15)."""
    events.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_files(files: DataFrame, root: str) -> None:
    """One file per row (name below the root, text), written in tasks and replaced if it is there."""
    def put(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:"))
        made = set()
        for b in batches:
            for name, text in zip(b["name"], b["text"]):
                path = f"{base}/{name}"
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(path) as out:
                    out.write(text.encode())
            yield b[["name"]]
    trees.dealt(files.select("name", "text"), "name").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()


def as_json_lines(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
