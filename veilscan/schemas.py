"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

ENTITY = "struct<text:string,label:string,score:float,start:int,end:int>"
TOKEN = "struct<start:int,end:int,label:string,score:float>"
CHUNK = "struct<chunk_idx:int,offset:int,text:string>"

FILES = "path string, modificationTime timestamp, length bigint, content binary"

RESULT_COLUMNS = ["status", "entities", "pii_count", "file_size_bytes", "chunks_processed", "error"]
