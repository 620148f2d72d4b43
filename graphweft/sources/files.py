"""Reading source trees, their configuration and their changes as DataFrames.

Contents are columns, so a tree of any size is scanned in parallel; nothing here opens a file on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.functions.expressions import version

#: Folders that a scan leaves out.
IGNORED = ["node_modules", "dist", "build", ".git"]
PROJECT = "struct<projectType:string,root:string,sourceRoot:string,tags:array<string>>"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content and kind (ts, html, spec) of the sources below a folder in any store that Spark reads."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{ts,html}")
    rows = files.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("value").alias("content"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in IGNORED)))).withColumn("kind", file_kind(F.col("path")))


def file_kind(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".spec.ts")), "spec").when(F.endswith(path, F.lit(".ts")), "ts").otherwise("html")


def workspace_projects(configs: DataFrame) -> DataFrame:
    """name, type, source_root and tags of all projects in workspace files (path, content) with a map of projects."""
    parsed = F.from_json("content", f"defaultProject string, projects map<string,{PROJECT}>")
    rows = configs.select("path", parsed.alias("c")).select("path", F.col("c.defaultProject").alias("chosen"), F.explode("c.projects").alias("name", "p"))
    kind = F.when(F.col("p.projectType") == "library", "library").otherwise("application")
    root = F.coalesce("p.sourceRoot", F.concat_ws("/", F.nullif(F.col("p.root"), F.lit("")), F.lit("src")))
    return rows.select("path", "name", kind.alias("type"), root.alias("source_root"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"), F.col("name").eqNullSafe(F.col("chosen")).alias("is_default"))


def folder_projects(configs: DataFrame) -> DataFrame:
    """workspace, name, type and source_root of projects with a file of their own, of configs (path, content).

    A workspace is a folder with nx.json; its projects are apps/*/project.json below it. A project without a name has its
    folder's, one without a source root has src. Libraries are told by their type, so that a caller may leave them out.
    """
    at = F.regexp_extract("path", r"^(.*?)/?nx\.json$", 1)
    roots = configs.where(F.col("path").rlike(r"(^|/)nx\.json$")).select(at.alias("workspace")).distinct()
    found = r"^(.*?)/?apps/([^/]+)/project\.json$"
    parsed = F.from_json("content", "name string, projectType string, sourceRoot string")
    rows = configs.where(F.col("path").rlike(found)).select(F.regexp_extract("path", found, 1).alias("workspace"), F.regexp_extract("path", found, 2).alias("folder"), parsed.alias("c"))
    kind = F.when(F.col("c.projectType") == "library", "library").otherwise("application")
    return rows.join(roots, "workspace", "left_semi").select("workspace", F.coalesce("c.name", "folder").alias("name"), kind.alias("type"), F.coalesce("c.sourceRoot", F.lit("src")).alias("source_root"))


def workspace_applications(configs: DataFrame) -> DataFrame:
    """workspace, name and source_root of all applications: of folders with nx.json, else of their angular.json."""
    own = folder_projects(configs).where("type = 'application'").select("workspace", "name", "source_root")
    nx = configs.where(F.col("path").rlike(r"(^|/)nx\.json$")).select(F.regexp_replace("path", r"/?nx\.json$", "").alias("workspace")).distinct()
    one = workspace_projects(configs.where(F.col("path").rlike(r"(^|/)angular\.json$"))).where("type = 'application'")
    rest = one.select(F.regexp_replace("path", r"/?angular\.json$", "").alias("workspace"), "name", "source_root").join(nx, "workspace", "left_anti")
    return own.unionByName(rest)


def applications(projects: DataFrame) -> DataFrame:
    """Per workspace file the default application, else the first by name."""
    order = Window.partitionBy("path").orderBy(F.desc("is_default"), "name")
    return projects.where("type = 'application'").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def dependencies(manifests: DataFrame) -> DataFrame:
    """path, name and installed range of every dependency in package files; a plain one wins over one for development."""
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    entries = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
    plain, dev = entries(F.col("c.dependencies")), entries(F.col("c.devDependencies"))
    extra = F.filter(dev, lambda e: ~F.coalesce(F.map_contains_key(F.col("c.dependencies"), e["key"]), F.lit(False)))
    return manifests.select("path", parsed.alias("c")).select("path", F.explode(F.concat(plain, extra)).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("installed"))


def framework_versions(files: DataFrame, manifests: DataFrame, package: str = "@angular/core") -> DataFrame:
    """Each file with the major version that the nearest package file above it asks for; null where none does.

    Every folder above a file is looked up by equality, so no file meets all package files.
    """
    asked = dependencies(manifests).where(F.col("name") == package).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.get(version(F.col("installed")), F.lit(0)).alias("major"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = files.select("path", F.explode(above).alias("folder")).join(asked, "folder").groupBy("path").agg(F.max_by("major", F.length("folder")).alias("major"))
    return files.join(found, "path", "left")


def diff_changes(lines: DataFrame, root: str = "") -> DataFrame:
    """path and kind from name-status lines: A added, D deleted, others modified; of a rename the last path counts.

    Paths outside `root` and files other than .ts and .html are left out.
    """
    parts = F.split("line", "\t")
    letter = F.substring("line", 1, 1)
    kind = F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter.isin("M", "R", "C"), "modified")
    rows = lines.where(F.size(parts) > 1).select(F.element_at(parts, -1).alias("path"), kind.alias("kind"))
    return rows.where(F.col("kind").isNotNull() & F.startswith("path", F.lit(root)) & F.col("path").rlike(r"\.(ts|html)$"))


def is_configuration(path: Column) -> Column:
    """Whether a change of the file calls for looking at the projects again."""
    return F.element_at(F.split(path, "/"), -1).isin("angular.json", "nx.json", "project.json")
