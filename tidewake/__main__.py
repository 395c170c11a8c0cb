"""Command line: analyze, build-clean, analyze-clean."""

from __future__ import annotations

import argparse
from pathlib import Path

from tidewake import curation
from tidewake.plans import pipeline
from tidewake.session import get_session


def _at_least_one(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewake")
    sub = top.add_subparsers(dest="command", required=True)
    analyze, build, clean = sub.add_parser("analyze"), sub.add_parser("build-clean"), sub.add_parser("analyze-clean")
    analyze.add_argument("--input-dir", type=Path, default=Path("."))
    analyze.add_argument("--output-dir", type=Path, default=Path("outputs/latest"))
    analyze.add_argument("--members-file", "--members-csv", type=Path)
    analyze.add_argument("--exporter-json", type=Path)
    clean.add_argument("--output-dir", type=Path, default=Path("outputs/clean"))
    clean.add_argument("--batch-id")
    clean.add_argument("--auto-build", action=argparse.BooleanOptionalAction, default=True)
    clean.add_argument("--batch-subdir", action=argparse.BooleanOptionalAction, default=True)
    clean.add_argument("--force-clean", action="store_true")
    build.add_argument("--force", action="store_true")
    for p in (build, clean):
        p.add_argument("--raw-dir", type=Path, default=Path("datasets-raw"))
        p.add_argument("--clean-dir", type=Path, default=Path("datasets-clean"))
    for p in (analyze, build, clean):
        p.add_argument("--extra-members-file", type=Path)
    for p in (analyze, clean):
        p.add_argument("--min-shared-overlap", type=_at_least_one, default=2)
        p.add_argument("--with-ml", action=argparse.BooleanOptionalAction, default=True)
        p.add_argument("--ml-clusters", type=_at_least_one)
        p.add_argument("--ml-random-state", type=int, default=42)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = get_session()
    options = {} if a.command == "build-clean" else {"min_shared": a.min_shared_overlap, "with_ml": a.with_ml, "clusters": a.ml_clusters, "seed": a.ml_random_state}
    if a.command == "analyze":
        out = pipeline.run_raw(spark, a.input_dir, a.output_dir, a.members_file, a.exporter_json, a.extra_members_file, **options)
    elif a.command == "build-clean":
        batches, index = curation.build(spark, a.raw_dir, a.clean_dir, a.extra_members_file, a.force)
        out = {b.batch_id: f"{b.status} {b.folder}" for b in batches} | {"index": index}
    else:
        if a.auto_build:
            curation.build(spark, a.raw_dir, a.clean_dir, a.extra_members_file, a.force_clean)
        batch = curation.resolve(spark, a.clean_dir, a.batch_id)
        folder = a.output_dir / batch["batch_id"] if a.batch_subdir else a.output_dir
        out = pipeline.run_clean(spark, a.clean_dir, folder, batch["batch_id"], **options)
    for name, where in out.items():
        print(f"{name}: {where}")


if __name__ == "__main__":
    main()
