"""Schemas of the tables, as DDL."""

FILES = "file_path string, content_bytes binary, content string"
DECLARATIONS = (
    "file_path string, decl_id int, parent_id int, depth int, ordinal int, kind string, name string, start_line0 int, end_line0 int, "
    "annotations array<string>, modifiers array<string>, superclass string, interfaces array<string>, n_children int"
)
IMPORTS = "file_path string, ordinal int, path string, alias string, is_wildcard boolean"
#: One row per parsed file; DECLARATIONS and IMPORTS are its exploded columns.
PARSED = (
    "file_path string, content string, package_name string, line_count int, error string, "
    "imports array<struct<ordinal:int,path:string,alias:string,is_wildcard:boolean>>, "
    "declarations array<struct<decl_id:int,parent_id:int,depth:int,ordinal:int,kind:string,name:string,start_line0:int,end_line0:int,"
    "annotations:array<string>,modifiers:array<string>,superclass:string,interfaces:array<string>,n_children:int>>"
)
CHUNKS = (
    "file_path string, content string, start_line int, end_line int, chunk_index int, total_chunks int, declarations array<string>, "
    "package_name string, path_module string, chunk_type string, arch_role string, has_overlap boolean, vector array<float>"
)
REGISTRY = "file_path string, content_hash string, line_count int, build_module string"
FILE_MODELS = (
    "file_path string, package string, symbols array<string>, type_symbols array<string>, supertypes array<string>, "
    "imports array<struct<path:string,is_wildcard:boolean>>, role string"
)
REFERENCES = "file_path string, fan_in_count long, fan_in_ratio double, confidence double, source string, role string"
