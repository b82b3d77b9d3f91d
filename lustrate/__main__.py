"""Command line: ``python -m lustrate run|verify|lint``.

Files are always extracted in a process apart under their time limit, so ``--isolate-risky-extractors false``
changes nothing; ``--max-workers`` is the number of cores."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lustrate.plans import engine
from lustrate.plans.policy import PolicyError, load_limits
from lustrate.session import local_session


def boolean(text: str) -> bool:
    if text not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text == "true"


def workers(text: str) -> int:
    if int(text) < 1:
        raise argparse.ArgumentTypeError("at least 1")
    return int(text)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lustrate", exit_on_error=False)
    verbs = parser.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("run", exit_on_error=False)
    for flag in ("--input", "--output", "--policy"):
        run.add_argument(flag, required=True)
    run.add_argument("--limits", "--limits-json", dest="limits")
    run.add_argument("--digest", choices=("sha2-256", "blake3"), default="sha2-256")
    run.add_argument("--secret-key", "--secret-key-file", dest="secret_key")
    run.add_argument("--enable-tokenization", type=boolean)
    run.add_argument("--quarantine-copy", type=boolean, nargs="?", const=True, default=False)
    run.add_argument("--isolate-risky-extractors", type=boolean, default=True)
    run.add_argument("--max-workers", type=workers)
    run.add_argument("--strictness", choices=("strict",), default="strict")
    run.add_argument("--workdir")
    run.add_argument("--batch-bytes", type=workers, default=engine.BATCH_BYTES)
    verify = verbs.add_parser("verify", exit_on_error=False)
    for flag in ("--pack", "--policy"):
        verify.add_argument(flag, required=True)
    lint = verbs.add_parser("lint", exit_on_error=False)
    lint.add_argument("--policy", required=True)
    try:
        args = parser.parse_args(argv)
    except (argparse.ArgumentError, SystemExit):
        # What was typed may hold secrets, so it is not repeated.
        print("usage: lustrate run|verify|lint", file=sys.stderr)
        return engine.USAGE
    if args.verb == "lint":
        try:
            print(engine.policy_lint(args.policy))
            return engine.OK
        except PolicyError as e:
            print(e, file=sys.stderr)
            return engine.USAGE
    if args.verb == "verify":
        return engine.verify(local_session(), args.pack, args.policy)
    # A secret without tokenization, or the other way round, is a mistake that must not pass unseen.
    if args.enable_tokenization is not None and args.enable_tokenization != bool(args.secret_key):
        print("usage: --enable-tokenization true goes with --secret-key-file", file=sys.stderr)
        return engine.USAGE
    try:
        secret = Path(args.secret_key).read_bytes() if args.secret_key else None
        limits = load_limits(args.limits) if args.limits else None
    except (OSError, ValueError) as e:
        print(f"usage: {type(e).__name__}", file=sys.stderr)
        return engine.USAGE
    work = {}
    if args.workdir:
        # Intermediate tables; they hold content, so a link that leads elsewhere is refused.
        if Path(args.workdir).is_symlink():
            return engine.USAGE
        Path(args.workdir).mkdir(parents=True, exist_ok=True)
        work["spark.checkpoint.dir"] = f"file://{Path(args.workdir).resolve()}"
    spark = local_session(args.max_workers or "*", **work)
    return engine.run(spark, args.input, args.output, args.policy, limits, args.digest, secret, args.quarantine_copy, args.batch_bytes)


if __name__ == "__main__":
    sys.exit(main())
