"""Queries on small sources given here, for rules that no table exercises. Their SQL states the results to expect, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import language as L
from sedimenta.operators import calls as C
from sedimenta.operators import imports as I
from sedimenta.operators import resolution as R

_TREE = [
    ("go.mod", "module ex.org/m\n"), ("a/x.go", 'package a\n\nimport (\n\t"fmt"\n\t"ex.org/m/a/b"\n)\n'), ("a/x_test.go", "package a\n"), ("a/b/y.go", "package b\n"), ("a/b/z.go", "package b\n"),
    ("tsconfig.json", '{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'), ("packages/kit/package.json", '{"name": "@org/kit"}'), ("packages/kit/index.js", ""),
    ("src/app.ts", "import { u } from './util';\nimport l from './lib.js';\nimport { m } from '@/lib';\nimport kit from '@org/kit';\nimport React from 'react';\nexport * from './types';\nconst p = import('./lazy');\n"),
    ("src/util/index.ts", ""), ("src/lib.ts", ""), ("src/types.d.ts", ""), ("src/lazy.tsx", ""),
    ("m/pkg/__init__.py", ""), ("m/pkg/core.py", "import top, deep.mod\nfrom .io import read\nfrom ..pkg import core\nimport os\n"), ("m/pkg/io.py", ""), ("src/top.py", ""), ("pyproject.toml", '[tool.x]\nwhere = ["py"]\n'), ("py/deep/mod.py", ""),
    ("src/main/java/org/a/B.java", "package org.a;\nimport org.c.D;\nimport static org.c.D.make;\n"), ("mod1/src/main/java/org/c/D.java", "import org.a.B.Inner;\n"),
    ("c/a.c", '#include <stdio.h>\n#include "inc/h.h"\n'), ("c/inc/h.h", ""), ("lib/r.rb", ""), ("app/one.rb", "require 'r'\nrequire_relative 'two'\n"), ("app/two.rb", ""),
    ("composer.json", '{"autoload": {"psr-4": {"App\\\\": "app/"}}}'), ("app/Models/User.php", "<?php\nnamespace App\\Models;\nuse Old\\{Thing, Gone};\nclass User {}\n"), ("web/x.php", "<?php namespace Old;\nuse App\\Models\\User;\nrequire __DIR__ . '/y.php';\nclass Thing {}\n"), ("web/y.php", ""),
    ("src/net/mod.rs", "mod tcp;\n"), ("src/net/tcp.rs", "use crate::net::{helper, tcp::{Conn, self}};\nuse std::io;\n"), ("src/lib.rs", "mod net;\n"),
    ("cs/Store.cs", "namespace Shop.Data;\nclass S {}\n"), ("cs/Other.cs", "using System;\nusing Shop.Data;\n"),
    ("pubspec.yaml", "name: shop\n"), ("lib/ui/page.dart", ""), ("lib/main.dart", "import 'package:shop/ui/page.dart';\nimport 'ui/page.dart';\nimport 'dart:io';\n"),
    ("ex/a.ex", "defmodule Shop.Cart do\nend\n"), ("ex/b.ex", "alias Shop.{Cart, Gone}\n"), ("lua/a/b.lua", ""), ("lua/m.lua", 'local b = require("lua.a.b")\n'),
    ("scenes/p.gd", "class_name Player\n"), ("scenes/q.tscn", '[ext_resource type="Script" path="res://scenes/p.gd" id=1]\n'), ("css/_base.scss", ""), ("css/app.scss", "@use 'base';\n@import 'https://x.example/y.css';\n"),
    ("sh/env.sh", ""), ("sh/run.sh", ". ./env.sh\n"),
]
_TARGETS = [
    ("a/x.go", "fmt", None), ("a/x.go", "ex.org/m/a/b", "a/b/y.go"), ("src/app.ts", "./util", "src/util/index.ts"), ("src/app.ts", "./lib.js", "src/lib.ts"), ("src/app.ts", "@/lib", "src/lib.ts"), ("src/app.ts", "@org/kit", "packages/kit/index.js"),
    ("src/app.ts", "react", None), ("src/app.ts", "./types", "src/types.d.ts"), ("src/app.ts", "./lazy", "src/lazy.tsx"), ("m/pkg/core.py", "top", "src/top.py"), ("m/pkg/core.py", "deep.mod", "py/deep/mod.py"), ("m/pkg/core.py", ".io", "m/pkg/io.py"),
    ("m/pkg/core.py", "..pkg", "m/pkg/__init__.py"), ("m/pkg/core.py", "os", None), ("src/main/java/org/a/B.java", "org.c.D", "mod1/src/main/java/org/c/D.java"), ("src/main/java/org/a/B.java", "org.c.D.make", None),
    ("mod1/src/main/java/org/c/D.java", "org.a.B.Inner", "src/main/java/org/a/B.java"), ("c/a.c", "inc/h.h", "c/inc/h.h"), ("app/one.rb", "r", "lib/r.rb"), ("app/one.rb", "two", "app/two.rb"),
    ("app/Models/User.php", "Old\\Thing", "web/x.php"), ("app/Models/User.php", "Old\\Gone", None), ("web/x.php", "App\\Models\\User", "app/Models/User.php"), ("web/x.php", "/y.php", "web/y.php"),
    ("src/net/mod.rs", "tcp", "src/net/tcp.rs"), ("src/net/tcp.rs", "crate::net::helper", "src/net/mod.rs"), ("src/net/tcp.rs", "crate::net::tcp::Conn", None), ("src/net/tcp.rs", "crate::net::tcp", "src/net/mod.rs"), ("src/net/tcp.rs", "std::io", None), ("src/lib.rs", "net", "src/net/mod.rs"),
    ("cs/Other.cs", "System", None), ("cs/Other.cs", "Shop.Data", "cs/Store.cs"), ("lib/main.dart", "package:shop/ui/page.dart", "lib/ui/page.dart"), ("lib/main.dart", "ui/page.dart", "lib/ui/page.dart"), ("lib/main.dart", "dart:io", None),
    ("ex/b.ex", "Shop.Cart", "ex/a.ex"), ("ex/b.ex", "Shop.Gone", None), ("lua/m.lua", "lua.a.b", "lua/a/b.lua"), ("scenes/q.tscn", "res://scenes/p.gd", "scenes/p.gd"), ("css/app.scss", "base", "css/_base.scss"), ("sh/run.sh", "./env.sh", "sh/env.sh"),
]
_PROGRAM = [
    ("app.ts", "import { run as go, stop } from './lib';\nimport * as all from './more';\nimport Def from './lib';\n\nfunction main() {\n  go(1);\n  all.extra();\n  helper();\n  Def();\n  unknown();\n  if (x) { stop(); }\n}\n\nfunction helper() {\n  return 'run(2)'; // stop(3)\n}\n"),
    ("lib.ts", "export function run(n) {\n  return inner(n);\n}\nfunction inner(n) {\n  return n;\n}\nexport { halt as stop } from './deep';\nexport default function start() {\n}\n"),
    ("deep.ts", "export * from './lib';\nexport function halt() {\n}\n"), ("more.ts", "export * from './deep2';\n"), ("deep2.ts", "export function extra() {\n}\nfunction hidden() {\n}\n"),
    ("a.py", "from b import job as work\nimport b\n\nclass K:\n    def m(self):\n        work()\n        b.other()\n        self.n()\n\n    def n(self):\n        pass\n\nwork()\n"), ("b.py", "def job():\n    pass\n\ndef other():\n    def nested():\n        job()\n"),
    ("m.go", "package m\n\nfunc A() {\n\tB()\n\tfmt.Println(\"B()\")\n}\n"), ("n.go", "package m\n\nfunc B() {\n}\n\nfunc (t T) B() {\n}\n"),
]
_DEPENDENCIES = [("m.go", "n.go"), ("app.ts", "lib.ts"), ("app.ts", "more.ts"), ("a.py", "b.py")]
_CALLS = [
    ("app.ts::main#5", "go", 6, "unique", "lib.ts::run#1"), ("app.ts::main#5", "extra", 7, "unique", "deep2.ts::extra#1"), ("app.ts::main#5", "helper", 8, "local", "app.ts::helper#14"), ("app.ts::main#5", "Def", 9, "unique", "lib.ts::start#8"),
    ("app.ts::main#5", "unknown", 10, "unresolved", ""), ("app.ts::main#5", "stop", 11, "unique", "deep.ts::halt#2"), ("lib.ts::run#1", "inner", 2, "local", "lib.ts::inner#4"), ("a.py::K.m#5", "work", 6, "unique", "b.py::job#1"),
    ("a.py::K.m#5", "other", 7, "unique", "b.py::other#4"), ("a.py::K.m#5", "n", 8, "local", "a.py::K.n#10"), ("a.py::<module>#1", "work", 13, "unique", "b.py::job#1"), ("b.py::other.nested#5", "job", 6, "local", "b.py::job#1"),
    ("m.go::A#3", "B", 4, "multiple-candidates", "n.go::B#3,n.go::B#6"), ("m.go::A#3", "Println", 5, "unresolved", ""),
]


def _files(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(sources, "rel_path string, content string").withColumn("project", F.lit("p"))
    return rows.withColumn("language", L.language_of(F.col("rel_path")))


def import_rules(spark: SparkSession, d: str) -> DataFrame:
    """The target of every import of a small tree in many languages."""
    files = _files(spark, _TREE)
    found = I.extract(files.withColumn("chunk_id", F.col("rel_path")))
    return R.resolve_all(found, files).select("rel_path", "specifier", "target")


def call_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every call of a few sources with the symbol it stands in and what it resolves to."""
    files = _files(spark, _PROGRAM)
    found = I.extract(files.withColumn("chunk_id", F.col("rel_path")))
    targets = R.resolve_all(found, files).select("project", F.col("rel_path").alias("file"), F.col("specifier").alias("source_module"), "target").where("target is not null").distinct()
    edges = spark.createDataFrame([("p", *x) for x in _DEPENDENCIES], "project string, file string, dep string")
    done = C.resolve_sites(C.call_sites(files), C.symbols_of(files), edges, targets, C.reexports_of(files))
    return done.select("caller", "callee", "line", "confidence", F.array_join("candidates", ",").alias("targets"))


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


QUERIES = {"import_rules": import_rules, "call_rules": call_rules}
SQL = {"import_rules": _values(_TARGETS, "rel_path, specifier, target"), "call_rules": _values(_CALLS, "caller, callee, line, confidence, targets")}
