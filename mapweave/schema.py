"""Schemas of elements and changes."""

from __future__ import annotations

TAGS = "array<struct<k:string,v:string>>"
INFO = "struct<version:int,ts_s:bigint,changeset:bigint,uid:int,user:string,visible:boolean>"
LOCATIONS = "array<struct<lat_e7:int,lon_e7:int>>"
MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"
NODES = f"id bigint, lat_e7 int, lon_e7 int, tags {TAGS}, info {INFO}"
WAYS = f"id bigint, tags {TAGS}, refs array<bigint>, locations {LOCATIONS}, info {INFO}"
RELATIONS = f"id bigint, tags {TAGS}, members {MEMBERS}, info {INFO}"
#: One row an element of any kind, as files and change streams carry them; kind is n, w or r.
ELEMENTS = f"kind string, id bigint, lat_e7 int, lon_e7 int, tags {TAGS}, refs array<bigint>, locations {LOCATIONS}, members {MEMBERS}, info {INFO}"
CHANGES = f"seq bigint, action string, {ELEMENTS}"
KINDS = ("n", "w", "r")
