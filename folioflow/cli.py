"""Command line: parse, export, documents, changes, history, view, schemas, models.

Every command works on a store folder; the session is local unless one is
running.  Exit codes: 0 done, 1 error, 2 usage, 3 unsupported format, 4
unreadable file, 5 not found.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import tempfile

from folioflow.errors import EXIT_CODES, EngineError, ModelError


def _at_least(least: int):
    def number(text: str) -> int:
        value = int(text)
        if value < least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return value

    return number


def _some(text: str) -> str:
    if not text:
        raise argparse.ArgumentTypeError("must not be empty")
    return text


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow")
    p.add_argument("--store", type=_some, default=os.path.join(os.path.expanduser("~"), ".folioflow"), help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "view"):
        c = sub.add_parser(name)
        c.add_argument("file", type=_some)
        c.add_argument("--id", type=_some, dest="document_id")
        c.add_argument("--force", action="store_true")
        c.add_argument("--out", type=_some)
        if name == "parse":
            c.add_argument("--format", choices=("json", "md"), default="json")
    c = sub.add_parser("export")
    c.add_argument("document_id", type=_some)
    c.add_argument("--version", type=_at_least(1))
    c.add_argument("--format", choices=("json", "md"), default="json")
    c.add_argument("--assets", type=_some, help="folder for the figures' images")
    c.add_argument("--out", type=_some)
    sub.add_parser("documents")
    c = sub.add_parser("changes")
    c.add_argument("--cursor", type=_at_least(0))
    c.add_argument("--limit", type=_at_least(1), default=100)
    c = sub.add_parser("history")
    c.add_argument("document_id", type=_some)
    c.add_argument("--version", type=_at_least(1))
    c = sub.add_parser("schemas")
    c.add_argument("folder", type=_some)
    c.add_argument("--check", action="store_true")
    c = sub.add_parser("models", help="verify model files against a manifest of name, path, bytes and sha256")
    c.add_argument("manifest", type=_some)
    return p


def replace_file(path: str, data: bytes) -> None:
    """Write beside the target and swap, so that a failure leaves the old file whole; a link is replaced, not followed."""
    folder = os.path.realpath(os.path.dirname(path) or ".")
    mode = os.umask(0)
    os.umask(mode)
    target = os.path.join(folder, os.path.basename(path))
    mode = os.stat(target).st_mode & 0o777 if os.path.isfile(target) and not os.path.islink(target) else 0o666 & ~mode
    handle, name = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def _emit(text: str, out: str | None) -> None:
    if out is None:
        sys.stdout.buffer.write(text.encode("utf-8", "replace") + (b"" if text.endswith("\n") else b"\n"))
        sys.stdout.buffer.flush()
    else:
        replace_file(out, text.encode("utf-8", "replace"))


def write_assets(engine, blocks, folder: str, out: str | None) -> None:
    """One PNG for each image that the blocks name; refused when the output would be one of them."""
    from pyspark.sql import functions as F

    keys = [r["a"] for r in blocks.where("figure.asset IS NOT NULL").select(F.col("figure.asset").alias("a")).distinct().collect()]  # one document's
    paths = {k: os.path.join(folder, k.removeprefix("sha256:")[:16] + ".png") for k in keys}
    same = lambda p: os.path.normcase(os.path.realpath(p)).casefold()
    if out is not None and same(out) in {same(folder), *map(same, paths.values())}:
        raise EngineError(f"output path is also an asset file: {out}")
    os.makedirs(folder, exist_ok=True)
    for key, path in paths.items():
        replace_file(path, engine.asset(key))


def verify_models(manifest: str) -> list[str]:
    """Paths of the manifest's files, each with the pinned size and digest."""
    with open(manifest, encoding="utf-8") as f:
        entries = json.load(f)["files"]
    out = []
    for e in entries:
        path = os.path.join(os.path.dirname(manifest), e["path"])
        if not os.path.isfile(path):
            raise ModelError(f"{e['name']}: no file {path}")
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
        if os.path.getsize(path) != e["bytes"] or digest.hexdigest() != e["sha256"]:
            raise ModelError(f"{e['name']}: {path} is not the pinned file")
        out.append(path)
    return out


def run(args: argparse.Namespace, spark=None) -> int:
    from folioflow import schemas

    if args.command == "models":
        _emit("\n".join(verify_models(args.manifest)), None)
        return 0
    from pyspark.sql import SparkSession

    from folioflow.engine import Engine

    spark = spark or SparkSession.builder.master("local[*]").appName("folioflow").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.command == "schemas":
        if args.check:
            bad = schemas.check(args.folder)
            _emit("\n".join(bad) or "up to date", None)
            return 1 if bad else 0
        for name in schemas.export(args.folder):
            _emit(name, None)
        return 0
    if getattr(args, "out", None) and os.path.isdir(args.out):
        raise EngineError(f"output path is a directory: {args.out}")
    engine = Engine(spark, args.store)
    rows = lambda df: json.dumps([json.loads(x) for x in df.toJSON().collect()], ensure_ascii=False, indent=2)
    if args.command in ("parse", "view"):
        with open(args.file, "rb") as f:
            data = f.read()
        given = spark.createDataFrame([(os.path.basename(args.file), bytearray(data), args.document_id)], "name string, content binary, document_id string")
        r = engine.ingest(given, args.force).first()
        if r["status"] == "rejected":
            print(f"folioflow: {r['name']}: {r['message']}", file=sys.stderr)
            return EXIT_CODES[r["error_code"]]
        if args.command == "view":
            from folioflow.operators.view import view_name

            out = args.out or view_name(args.file)
            replace_file(out, engine.view(r["document_id"], r["version"], r["version"] - 1 if r["version"] > 1 else None).encode("utf-8", "replace"))
            _emit(out, None)
        else:
            _emit(engine.markdown(r["document_id"], r["version"]) if args.format == "md" else engine.tree_json(r["document_id"], r["version"]), args.out)
    elif args.command == "export":
        if args.assets:
            write_assets(engine, engine.tree(args.document_id, args.version), args.assets, args.out)
        link = None
        if args.assets:
            link = os.path.relpath(args.assets, os.path.dirname(args.out) or ".") if args.out else args.assets
        _emit(engine.markdown(args.document_id, args.version, link) if args.format == "md" else engine.tree_json(args.document_id, args.version), args.out)
    elif args.command == "documents":
        _emit(rows(engine.documents()), None)
    elif args.command == "changes":
        page, head = engine.changes(args.cursor, args.limit)
        _emit(json.dumps({**head, "changes": json.loads(rows(page))}, ensure_ascii=False, indent=2), None)
    else:
        _emit(rows(engine.history(args.document_id, args.version)), None)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 2
    try:
        return run(args, spark)
    except EngineError as e:
        print(f"folioflow: {e}", file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(f"folioflow: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
