"""Fact tables of a code base: schemas and loading.

Lexical facts can be made here (:mod:`lodeworks.sources.projects`, :mod:`lodeworks.functions.lexer`, :mod:`lodeworks.sources.patches`); facts that
need a compiler's semantic model are read as given.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import is_generated
from lodeworks.operators.closure import closure

SCHEMAS = {
    "projects": "path string, assembly_name string, sdk string, output_type string, is_test boolean, is_loaded boolean, tfms array<string>, framework_refs array<string>",
    "project_refs": "path string, ref_path string, private_all boolean, output_disabled boolean, is_analyzer boolean, line int",
    "package_refs": "path string, id string, min_version string, compile_excluded boolean, private_all boolean, line int",
    "lock_packages": "path string, tfm string, id string, version string",
    "lock_deps": "path string, tfm string, id string, dep_id string, min_version string",
    "inbox_packages": "tfm string, aspnet boolean, id string, version string",
    "package_assemblies": "path string, id string, assembly string",
    "used_assemblies": "path string, assembly string",
    "documents": "doc_id string, path string, project string, text string, namespace string, is_generated boolean",
    "lines": "path string, line int, text string",
    "tokens": "path string, idx int, tok string, line int, ch int",
    "identifiers": "path string, line int, text string, project string",
    "exec_lines": "path string, line int",
    "comments": "path string, line int, ch int, kind string, text string",
    "usings": "path string, pos int, name string, is_global boolean, is_static boolean, alias string, diagnostic string, line int",
    "string_literals": "path string, text string",
    "ast_nodes": "body_id string, node_id long, parent_id long, ord int, kind string, operator string, line int",
    "statements": "block_id string, path string, ord int, line int, ch int, exits boolean, start_reachable boolean, kind string",
    "declarations": "symbol_id string, kind string, name string, accessibility string, type_id string, project string, path string, line int, ch int, is_static boolean, is_virtual boolean, is_override boolean, is_abstract boolean, is_sealed boolean, attributes array<string>, has_friends boolean, span_end int, uses_instance boolean, is_empty boolean, parameters int",
    "references": "symbol_id string, path string, pos int, line int, kind string, is_candidate boolean, is_direct_invocation boolean, is_subscription boolean",
    "inherits": "derived_id string, base_id string",
    "overrides": "symbol_id string, base_symbol_id string",
    "implements": "symbol_id string, contract_symbol_id string",
    "type_edges": "type_id string, used_type_id string, via string",
    "invocation_args": "symbol_id string, path string, line int, is_last boolean, named boolean, literal boolean, equals_default boolean, rebinds_same boolean",
    "type_args": "path string, line int, inferred_same boolean, nullable_or_dynamic boolean",
    "casts": "path string, line int, target string, identity boolean, implicit_reference boolean, safe_parent boolean",
    "qualifiers": "path string, line int, text string, kind string, rebinds_same boolean",
    "namespaces": "path string, name string, line int, end_line int, file_scoped boolean",
    "roots": "folder string",
    "config_leaves": "file string, key string, last_segment string, line int",
    "option_leaves": "type_id string, path string, property string",
    "commits": "sha string, log_pos long, author_ts timestamp, subject string, is_merge boolean",
    "commit_files": "sha string, path string",
    "hunks": "sha string, path string, old_start int, old_count int, new_start int, new_count int, added array<string>, removed array<string>, changed_new_lines array<int>, is_file_creation boolean",
    "numstat": "path string, added int, deleted int",
    "spelled_names": "path string, text string",
    "findings": "rule_id string, title string, message string, certainty tinyint, category tinyint, file_path string, line_number int, character_offset int, symbol_id string, related array<struct<file_path:string,line_number:int>>",
    "baseline": "fingerprint string",
    "ledger": "commit_sha string, recorded_at_utc string, new_findings int, resolved_findings int, lines_changed int, baseline_commit_sha string, findings_per_kloc double, scored boolean",
}


class Facts:
    """The tables of a folder (``NAME.parquet``) or given ones; one that is not there is empty."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self._tables = spark, folder, dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            schema = SCHEMAS[name]
            if self.folder and self._exists(f"{self.folder}/{name}.parquet"):
                self._tables[name] = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}.parquet")
            else:
                self._tables[name] = self.spark.createDataFrame([], schema)
        return self._tables[name]

    def has(self, name: str) -> bool:
        return name in self._tables or bool(self.folder) and self._exists(f"{self.folder}/{name}.parquet")

    def any(self) -> bool:
        """Whether there is a table at all."""
        return any(self.has(name) for name in SCHEMAS)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @cached_property
    def skipped_paths(self) -> DataFrame:
        """(path) of documents that rules don't read: generated by name or flag, outside all roots, or with a generator's header."""
        docs = self["documents"].select("path", "is_generated")
        named = docs.where(F.coalesce("is_generated", F.lit(False)) | is_generated(F.col("path"))).select("path")
        head = self["tokens"].groupBy("path").agg(F.min("line").alias("first"))
        marked = self["comments"].where(F.col("text").contains("<auto-generated")).select("path", "line").join(head, "path", "left")
        marked = marked.where("first is null or line <= first").select("path")
        slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
        roots = self["roots"].select(F.rtrim(slash(F.col("folder")), F.lit("/")).alias("folder"))
        # folders around each path meet the roots
        parts = F.split(slash(F.col("path")), "/")
        around = docs.where("path is not null").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"))
        inside = around.join(roots, "folder", "left_semi").select("path")
        outside = docs.select("path").where("path is not null").join(inside, "path", "left_anti") if self.has("roots") and not roots.isEmpty() else docs.select("path").limit(0)
        return named.union(marked).union(outside).distinct()

    def read(self, name: str) -> DataFrame:
        """A table with a column ``path``, without the documents that rules don't read."""
        return self[name].join(self.skipped_paths, "path", "left_anti")

    @cached_property
    def entry_types(self) -> DataFrame:
        """(type_id) of types that a framework, a test runner or the runtime calls."""
        d = self["declarations"]
        bare = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^.]+)$", 1), "[`<].*$", "")
        bases = closure(self["inherits"].select(F.col("derived_id").alias("src"), F.col("base_id").alias("dst"))) if self.has("inherits") else None
        parts = [
            d.where((F.col("kind") == "type") & carries("attributes", ("ApiController",))).select(F.col("symbol_id").alias("type_id")),
            d.where(F.col("name").isin("Main", "<Main>$") & (F.col("kind") == "method")).select("type_id"),
            d.where((F.col("kind") == "method") & carries("attributes", (*TEST_ATTRIBUTES, "ModuleInitializer"))).select("type_id"),
        ]
        if bases is not None:
            parts.append(bases.where(bare(F.col("node")).isin(*CONTROLLERS, *HANDLERS)).select(F.col("root").alias("type_id")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.where("type_id is not null").distinct()

    def judged(self, but: tuple[str, ...] = ()) -> DataFrame:
        """Declarations that rules may judge: no constructors, no excluded attributes (those in ``but`` are ignored), nothing of entry types."""
        d = self.read("declarations") if self.has("documents") or self.has("comments") else self["declarations"]
        names = tuple(n for n in EXCLUDED_ATTRIBUTES if n not in but)
        d = d.where(~F.col("kind").isin("constructor", "entry_point") & ~carries("attributes", names))
        entries = self.entry_types
        d = d.join(entries, "type_id", "left_anti").select(d.columns)
        return d.join(entries.select(F.col("type_id").alias("symbol_id")), "symbol_id", "left_anti").select(d.columns)

    @cached_property
    def consumers(self) -> DataFrame:
        """(root, node): projects that get what ``root`` has; a reference with private assets is reached, not gone on from."""
        edges = self["project_refs"].select(F.col("ref_path").alias("src"), F.col("path").alias("dst"), (~F.coalesce("private_all", F.lit(False))).alias("go"))
        return closure(edges, onward="go").select("root", "node")

    @cached_property
    def live_declarations(self) -> DataFrame:
        return self.judged()


def carries(column: str, names: tuple[str, ...]):
    """Whether an array of attribute names holds one of ``names``, with or without the ending ``Attribute``."""
    given = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda a: F.regexp_replace(a, "(?<=.)Attribute$", ""))
    return F.arrays_overlap(given, F.array(*map(F.lit, names)))


# Attributes whose holders are never judged.
EXCLUDED_ATTRIBUTES = ("Fact", "Theory", "Benchmark", "LoggerMessage", "GeneratedRegex", "Obsolete", "UsedImplicitly", "MeansImplicitUse", "PublicAPI", "ModuleInitializer", "CollectionDefinition")
# Attributes of test methods.
TEST_ATTRIBUTES = ("Fact", "Theory", "Test", "TestMethod", "TestCase")
# Base types and interfaces of types that a framework calls.
CONTROLLERS = ("ControllerBase", "Controller")
HANDLERS = ("IRequestHandler", "INotificationHandler", "IConsumer", "IJob", "IHostedService", "IEndpointFilter", "IAsyncLifetime")
# Attributes of members that a serializer reads or writes.
SERIALIZATION_ATTRIBUTES = ("JsonPropertyName", "JsonProperty", "JsonInclude", "JsonConstructor", "JsonExtensionData", "BsonElement", "BsonId", "BsonDiscriminator", "DataMember", "ProtoMember", "XmlElement", "XmlAttribute")
