"""Explicit schemas of the tables this package reads and writes, as DDL text."""

RAW_FILE = "path string, modificationTime timestamp, length long, content binary"
DOC_META = (
    "struct<filename:string,type:string,title:string,has_tables:boolean,table_count:int,char_count:int>"
)
EXTRACTION = (
    "nodes array<struct<id:string,type:string>>, "
    "edges array<struct<source:string,target:string,type:string>>"
)
NOTIFICATION = "Records array<struct<s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"
