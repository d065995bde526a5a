"""Declared schemas of the tables that operators exchange."""

from __future__ import annotations

IMPORT = "struct<source:string,specifiers:array<struct<name:string,alias:string,isDefault:boolean,isNamespace:boolean>>,isTypeOnly:boolean,isDynamic:boolean>"
EXPORT = "struct<name:string,type:string,isTypeOnly:boolean,source:string>"
FUNCTION = "struct<id:string,name:string,startLine:int,endLine:int,parameters:array<string>,returnType:string,isAsync:boolean,isExported:boolean,isGenerator:boolean,isArrow:boolean,complexity:int,decorators:array<string>,docComment:string>"
CLASS = "struct<id:string,name:string,startLine:int,endLine:int,methods:array<string>,properties:array<string>,decorators:array<string>,implements:array<string>,extends:string,isAbstract:boolean,isExported:boolean,visibility:string>"
COMMENT = "struct<text:string,type:string,startLine:int,endLine:int>"
FILE = (
    f"path string, id string, language string, hash string, size bigint, linesOfCode int, complexity int, imports array<{IMPORT}>, exports array<{EXPORT}>, "
    f"functions array<{FUNCTION}>, classes array<{CLASS}>, comments array<{COMMENT}>, error string"
)
MANIFEST = "path string, relativePath string, size bigint, modifiedAtMs bigint, language string, analyzable boolean, linesOfCode int"
EDGE = "src string, dst string, type string, is_type_only boolean, specifier_count bigint, is_external boolean"
CHANGED_FILE = "kind string, path string, previousPath string, oldBlobSha string, newBlobSha string, oldMode string, newMode string, contentKind string, binary boolean, gitlink boolean"


def check(df, ddl: str) -> None:
    """Raise where a table lacks a declared column or holds it with another type."""
    from pyspark.sql import types as T

    held = {f.name: f.dataType for f in df.schema}
    for f in T.StructType.fromDDL(ddl):
        if f.name not in held:
            raise ValueError(f"column {f.name} is missing")
        if held[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {held[f.name].simpleString()}, not {f.dataType.simpleString()}")
