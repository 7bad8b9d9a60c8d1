"""Languages by file extension, the syntax nodes that become chunks, and the kinds of nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    top_level: frozenset[str]
    splittable: frozenset[str]


def _language(name: str, extensions: str, top_level: str, splittable: str = "") -> Language:
    return Language(name, tuple(extensions.split()), frozenset(top_level.split()), frozenset(splittable.split()))


_JS = "export_statement lexical_declaration variable_declaration class_declaration generator_function_declaration function_declaration"
_TS = _JS + " enum_declaration type_alias_declaration interface_declaration abstract_class_declaration"
_TS_SPLIT = "interface_declaration abstract_class_declaration class_declaration"
LANGUAGES = (
    _language("c", ".h .c", "struct_specifier enum_specifier type_definition declaration function_definition preproc_function_def preproc_def"),
    _language("c_sharp", ".cs", "namespace_declaration method_declaration record_declaration enum_declaration struct_declaration interface_declaration class_declaration", "namespace_declaration struct_declaration interface_declaration class_declaration"),
    _language("cpp", ".hxx .hh .hpp .cxx .cc .cpp", "declaration template_declaration namespace_definition enum_specifier struct_specifier class_specifier function_definition", "namespace_definition struct_specifier class_specifier"),
    _language("go", ".go", "var_declaration const_declaration type_declaration method_declaration function_declaration"),
    _language("java", ".java", "record_declaration enum_declaration interface_declaration class_declaration", "enum_declaration interface_declaration class_declaration"),
    _language("javascript", ".cjs .mjs .jsx .js", _JS, "class_declaration"),
    _language("php", ".php", "enum_declaration function_definition trait_declaration interface_declaration class_declaration", "trait_declaration interface_declaration class_declaration"),
    _language("python", ".pyi .py", "decorated_definition class_definition function_definition", "class_definition"),
    _language("ruby", ".rb", "assignment singleton_method method class module", "class module"),
    _language("rust", ".rs", "mod_item macro_definition static_item const_item type_item trait_item impl_item enum_item struct_item function_item", "mod_item trait_item impl_item"),
    _language("scala", ".sc .scala", "val_definition function_definition trait_definition object_definition class_definition", "trait_definition object_definition class_definition"),
    _language("tsx", ".tsx", _TS, _TS_SPLIT),
    _language("typescript", ".cts .mts .ts", _TS, _TS_SPLIT),
    _language("zig", ".zig", "test_declaration variable_declaration function_declaration"),
)
BY_NAME = {x.name: x for x in LANGUAGES}
BY_EXTENSION = {e: x for x in LANGUAGES for e in x.extensions}


def detect(path: str) -> Language | None:
    """By the last extension, case counting."""
    dot = path.rfind(".")
    return BY_EXTENSION.get(path[dot:]) if dot >= 0 else None


def supported_extensions() -> list[str]:
    return sorted(BY_EXTENSION)


def registry(spark: SparkSession) -> DataFrame:
    """(ext, language): 27 rows, safe to broadcast."""
    return spark.createDataFrame(sorted((e, x.name) for e, x in BY_EXTENSION.items()), "ext string, language string")


def language_of(ext: Column) -> Column:
    """Language name of an extension; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(v) for e, x in sorted(BY_EXTENSION.items()) for v in (e, x.name)]), ext)


#: (test, words, kind): the first rule that holds names the kind; "has" looks within the type, "is" compares it.
KIND_RULES = (
    ("has", ("function",), "function"),
    ("has", ("struct",), "struct"),
    ("has", ("enum",), "enum"),
    ("has", ("impl",), "impl"),
    ("has", ("trait",), "trait"),
    ("is", ("type_definition", "type_declaration", "type_item", "type_alias_declaration"), "type"),
    ("has", ("const",), "const"),
    ("has", ("static",), "static"),
    ("has", ("macro",), "macro"),
    ("is", ("preproc_def",), "macro"),
    ("is", ("namespace_definition",), "namespace"),
    ("is", ("template_declaration",), "template"),
    ("has", ("mod",), "module"),
    ("has", ("class",), "class"),
    ("has", ("method",), "method"),
    ("has", ("interface",), "interface"),
    ("is", ("assignment", "val_definition", "var_declaration", "variable_declaration", "lexical_declaration"), "variable"),
    ("is", ("declaration",), "declaration"),
    ("is", ("decorated_definition",), "function"),
    ("is", ("test_declaration",), "test"),
    ("is", ("object_definition",), "object"),
    ("is", ("record_declaration",), "record"),
)


def node_kind(node_type: str) -> str:
    for test, words, kind in KIND_RULES:
        if node_type in words if test == "is" else any(w in node_type for w in words):
            return kind
    return node_type


def kind_of(node_type: Column) -> Column:
    """`node_kind` of a column."""
    out = None
    for test, words, kind in KIND_RULES:
        holds = node_type.isin(*words) if test == "is" else F.contains(node_type, F.lit(words[0]))
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.otherwise(node_type)
