"""Sources and sinks: match files, market snapshots, draft tables and exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: Headers that are read at a time.
HEADER_READS = 16


def file_headers(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...], str | None]]:
    """(file, columns, problem) of each CSV file of a path; a file whose head cannot be read, or has no columns, has a problem.

    Only the files' names and first lines come to the driver.
    """
    from multiprocessing.pool import ThreadPool
    from urllib.parse import unquote

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    def head(file: str):
        try:
            found = tuple(spark.read.option("header", True).csv(_literal(file)).columns)
        except (Py4JJavaError, PySparkException) as error:
            said = error.java_exception if isinstance(error, Py4JJavaError) else error
            return file, (), str(said).splitlines()[0][:200]
        return file, found, None if found else "no columns"

    files = sorted(unquote(f) for f in spark.read.format("binaryFile").load(path).inputFiles())
    with ThreadPool(HEADER_READS) as pool:
        return pool.map(head, files)


def _literal(file: str) -> str:
    """A file's name as a path without patterns."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in file)


def header_groups(headers: list[tuple[str, tuple[str, ...], str | None]], required: tuple[str, ...] = ()) -> tuple[dict[tuple[str, ...], list[str]], dict[str, str]]:
    """Files by their columns, and the problem of each file that cannot be used."""
    groups, problems = {}, {}
    for file, columns, problem in headers:
        missing = sorted(set(required) - set(columns))
        problem = problem or (f"missing columns: {', '.join(missing)}" if missing else None)
        if problem:
            problems[file] = problem
        else:
            groups.setdefault(columns, []).append(file)
    return groups, problems


def _rows_of(spark: SparkSession, columns: tuple[str, ...], files: list[str], kinds: dict[str, T.DataType], mode: str, corrupt: str | None = None) -> DataFrame:
    fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in columns] + ([T.StructField(corrupt, T.StringType())] if corrupt else [])
    reader = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", mode).option("ignoreCorruptFiles", True)
    return (reader.option("columnNameOfCorruptRecord", corrupt) if corrupt else reader).csv([_literal(f) for f in files])


def read_matches(spark: SparkSession, path: str, schema: T.StructType | None = None, text_columns: tuple[str, ...] = ("patch",), required: tuple[str, ...] = ()) -> DataFrame:
    """All CSV files of a path as one table by column names, with their own order kept in _file and _line.

    Files of one header are one scan; a column that a file lacks is null there.  Unreadable lines are dropped
    (``malformed_lines`` counts them), as are files without a readable head or without a ``required`` column
    (``rejected_files`` names them), and what follows a broken place of a compressed file.  Without a schema all
    columns are text, so that versions such as 15.10 keep their last zero.
    """
    groups, problems = header_groups(file_headers(spark, path), required)
    if not groups:
        raise ValueError(f"no readable CSV file: {'; '.join(f'{k}: {v}' for k, v in problems.items()) or path}")
    kinds = {} if schema is None else {f.name: T.StringType() if f.name in text_columns else f.dataType for f in schema.fields}
    scans = [_rows_of(spark, columns, files, kinds, "DROPMALFORMED").withColumn("_file", F.col("_metadata.file_path")) for columns, files in groups.items()]
    return union_all(scans).withColumn("_line", F.monotonically_increasing_id())


def rejected_files(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(file, problem) of each file that ``read_matches`` leaves out."""
    return spark.createDataFrame(list(header_groups(file_headers(spark, path), required)[1].items()), "file string, problem string")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """One table of frames with different columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def normalize_players(rows: DataFrame, roles: dict[str, str], leagues: dict[str, str], tier_one: list[str], international: list[str], primary: DataFrame | None = None, least_rows: int = 18, home: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Player rows of known roles and leagues, with source_league kept.

    primary holds (league, year, team); a league and year without an entry allows the
    teams with ``least_rows`` rows.  Show matches are dropped; internationals always pass.
    ``home`` names internationals whose rows of a primary team count for the team's own
    league, in a split of its own: {international: (league, split)}.
    """
    role = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    renamed = F.create_map(*(F.lit(x) for pair in leagues.items() for x in pair)) if leagues else None
    df = rows.where(~F.coalesce(F.lower("split").contains("showmatch"), F.lit(False)))
    df = df.withColumns({"source_league": F.trim("league"), "position": role[F.lower(F.trim("position"))]}).where(F.col("position").isNotNull())
    df = df.withColumn("league", F.coalesce(renamed[F.col("source_league")], "source_league") if renamed is not None else F.col("source_league"))
    if home and primary is not None:
        moved = F.create_map(*(x for name, (league, split) in home.items() for x in (F.lit(name), F.struct(F.lit(league).alias("league"), F.lit(split).alias("split")))))
        listed = primary.select(F.col("league").alias("_home"), F.col("year").alias("_year"), F.col("team").alias("_team")).distinct()
        df = df.withColumn("_to", moved[F.col("source_league")])
        df = df.join(listed, (F.col("_to.league") == F.col("_home")) & (F.col("year") == F.col("_year")) & (F.trim("teamname") == F.col("_team")), "left")
        at_home = F.col("_home").isNotNull()
        df = df.withColumns({"league": F.when(at_home, F.col("_home")).otherwise(F.col("league")), "split": F.when(at_home, F.col("_to.split")).otherwise(F.col("split"))}).drop("_to", "_home", "_year", "_team")
    abroad = F.col("source_league").isin(*international)
    df = df.where(F.col("league").isin(*tier_one) | abroad)
    teams = df.groupBy("league", "year", F.trim("teamname").alias("_team")).agg(F.count("*").alias("_rows"))
    if primary is not None:
        listed = primary.select("league", "year", F.col("team").alias("_team"), F.lit(True).alias("_listed")).distinct()
        covered = primary.select("league", "year").distinct().withColumn("_covered", F.lit(True))
        teams = teams.join(listed, ["league", "year", "_team"], "left").join(covered, ["league", "year"], "left")
    else:
        teams = teams.withColumns({"_listed": F.lit(None).cast("boolean"), "_covered": F.lit(None).cast("boolean")})
    allowed = teams.where(F.coalesce("_listed", F.lit(False)) | (F.col("_covered").isNull() & (F.col("_rows") >= least_rows)))
    met = df.withColumn("_team", F.trim("teamname")).join(allowed.select("league", "year", "_team", F.lit(True).alias("_allowed")), ["league", "year", "_team"], "left")
    return met.where(F.col("_allowed") | abroad).select(*df.columns)


MARKET = T.StructType.fromJson(
    json.loads(
        """{"type":"struct","fields":[
        {"name":"round","nullable":true,"metadata":{},"type":{"type":"struct","fields":[{"name":"id","type":"string","nullable":true,"metadata":{}},{"name":"name","type":"string","nullable":true,"metadata":{}}]}},
        {"name":"teams","nullable":true,"metadata":{},"type":{"type":"array","containsNull":true,"elementType":{"type":"struct","fields":[{"name":"id","type":"string","nullable":true,"metadata":{}},{"name":"code","type":"string","nullable":true,"metadata":{}},{"name":"name","type":"string","nullable":true,"metadata":{}}]}}},
        {"name":"roundPlayers","nullable":true,"metadata":{},"type":{"type":"array","containsNull":true,"elementType":{"type":"struct","fields":[{"name":"id","type":"string","nullable":true,"metadata":{}},{"name":"summonerName","type":"string","nullable":true,"metadata":{}},{"name":"role","type":"string","nullable":true,"metadata":{}},{"name":"teamId","type":"string","nullable":true,"metadata":{}},{"name":"price","type":"double","nullable":true,"metadata":{}},{"name":"previousPrice","type":"double","nullable":true,"metadata":{}},{"name":"opponentIds","nullable":true,"metadata":{},"type":{"type":"array","containsNull":true,"elementType":"string"}}]}}}]}"""
    )
)


def flatten_market(raw: DataFrame, captured_at: str) -> DataFrame:
    """One row a player of market documents of schema ``MARKET``, with team, opponents as pipe text, and price change."""
    known = F.map_from_entries(F.transform("teams", lambda t: F.struct(t["id"], F.struct(t["code"], t["name"]))))
    # bound as one entry, the teams of a document are mapped once and not for each player, and no player's row carries them all
    document = F.array(F.struct(known.alias("known"), F.col("roundPlayers").alias("players")))
    met = lambda known, p: F.struct(p.alias("p"), known[p["teamId"]].alias("team"), F.transform(p["opponentIds"], lambda x: known[x]["code"]).alias("opponents"))
    df = raw.select("round", F.flatten(F.transform(document, lambda d: F.transform(d["players"], lambda p: met(d["known"], p)))).alias("rows"))
    return df.select("round", F.explode("rows").alias("x")).select(
        F.lit(captured_at).cast("timestamp").alias("captured_at_utc"), F.col("round.id").alias("round_id"), F.col("round.name").alias("round_name"),
        F.col("x.p.id").alias("round_player_id"), F.col("x.p.summonerName").alias("summoner_name"), F.col("x.p.role").alias("role"), F.col("x.p.teamId").alias("team_id"),
        F.col("x.team.code").alias("team_code"), F.col("x.team.name").alias("team_name"), F.col("x.p.price").alias("price"), F.col("x.p.previousPrice").alias("previous_round_price"),
        F.bround(F.col("x.p.price") - F.col("x.p.previousPrice"), 4).alias("price_change"), F.array_join("x.opponents", "|").alias("opponent_codes"),
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Writes a snapshot that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def price_history(snapshots: DataFrame) -> DataFrame:
    """The latest capture of each player and round, gathered in round order: (summoner_name, prices)."""
    last = Window.partitionBy("summoner_name", "round_id").orderBy(F.col("captured_at_utc").desc(), "price")
    latest = snapshots.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    entry = F.struct("captured_at_utc", "round_id", "round_name", "price")
    return latest.groupBy("summoner_name").agg(F.array_sort(F.collect_list(entry)).alias("prices"))


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the schema if its path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_draft_tables(games: DataFrame, actions: DataFrame, path: str) -> None:
    """Games and actions as Parquet by year; a game or action that is not unique is an error."""
    for name, df, keys in (("games", games, ["gameid"]), ("draft_actions", actions, ["gameid", "action_number"])):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: {', '.join(keys)} is not unique")
        df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(f"{path}/{name}")


def export_csv(df: DataFrame, path: str, columns: list[str | Column] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_config(path: str) -> dict:
    """A small JSON file on the driver, whose values become literals of plans."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): how many lines of each CSV file do not fit its own columns; ``read_matches`` drops these."""
    counts = []
    for columns, files in header_groups(file_headers(spark, path))[0].items():
        df = _rows_of(spark, columns, files, {}, "PERMISSIVE", "_corrupt")
        # a line counts by all its columns, since a query of the corrupt column alone would not parse the others
        line = F.when(F.col("_corrupt").isNotNull() & (F.concat_ws("", *(F.col(f"`{c}`") for c in columns)) >= ""), 1)
        counts.append(df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(line).alias("lines")).where("lines > 0"))
    return union_all(counts) if counts else spark.createDataFrame([], "file string, lines long")


# What a draft needs of a team's row, and the player roles.
TEAM_COLUMNS = ("gameid", "league", "year", "date", "patch", "side", "teamname", "game", "ban1", "ban2", "ban3", "ban4", "ban5", "pick1", "pick2", "pick3", "pick4", "pick5")
PLAYER_ROLES = ("top", "jng", "mid", "bot", "sup")


def team_drafts(rows: DataFrame, leagues: list[str]) -> DataFrame:
    """The teams' rows of some leagues with a draft's columns only; bans and picks as arrays of five trimmed texts."""
    require_columns(rows, [*TEAM_COLUMNS, "position"])
    optional = [c for c in ("split", "playoffs", "firstPick", "result") if c in rows.columns]
    df = rows.where((F.lower("position") == "team") & F.col("league").isin(*leagues)).select(*TEAM_COLUMNS, *optional)
    items = {f"{kind}s": F.array(*(F.trim(F.coalesce(F.col(f"{kind}{k}"), F.lit(""))) for k in range(1, 6))) for kind in ("ban", "pick")}
    return df.withColumns(items).drop(*(f"{kind}{k}" for kind in ("ban", "pick") for k in range(1, 6)))


def player_rows(rows: DataFrame, leagues: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of players of known roles with a champion, of some leagues."""
    require_columns(rows, ["gameid", "league", "position", "playername", "champion"])
    df = rows.where(F.lower("position").isin(*PLAYER_ROLES) & F.col("league").isin(*leagues) & (F.trim(F.coalesce("champion", F.lit(""))) != ""))
    return df.select(*columns) if columns else df


def read_market(spark: SparkSession, path: str) -> DataFrame:
    """Market documents, one JSON object a file."""
    return spark.read.schema(MARKET).option("multiLine", True).json(path)


def read_model_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Draft actions with the role and player of each pick (table ``players``), only some columns if given; the scan reads no others."""
    actions = spark.read.parquet(f"{path}/draft_actions")
    players = spark.read.parquet(f"{path}/players").select("gameid", "team", "champion", "role", "player")
    df = actions.join(players, ["gameid", "team", "champion"], "left")
    return df.select(*columns) if columns else df


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot whose folder's name is last, of a path with a folder for each."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return df.join(F.broadcast(df.agg(F.max("_folder").alias("_folder"))), "_folder").drop("_folder")


def cached_table(spark: SparkSession, path: str, key: dict, build) -> DataFrame:
    """A table kept under a name made of its key's values; built and written only if it is not there."""
    import hashlib

    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    build().write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a table: trials as they end, or new findings."""
    df.write.mode("append").parquet(path)


def load_learnings(spark: SparkSession, path: str) -> DataFrame:
    """(category, severity, at, snippets) after all findings (category, severity, snippet, at) of a table; empty without one."""
    from driftline.operators.vectors import learn

    kept = read_or_empty(spark, path, "category string, severity double, snippet string, at timestamp")
    return learn(kept, kept.limit(0))
