"""Command line: ``python -m tallywright [--init] [--analyze WORDS] [--words WORDS]``."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from tallywright.config import Config, ConfigurationError, EntitlementError, StatementError

log = logging.getLogger("tallywright")
# Exit codes.
OK, BAD_CONFIG, NOT_FOUND, NO_PERMISSION, OTHER, NOT_ENTITLED, INTERRUPTED = 0, 1, 2, 3, 4, 5, 130


def init_directories(base: str, samples: bool = False) -> list[str]:
    made = [os.path.join(base, n) for n in ("input", "output", "logs", "custom_templates")]
    for folder in made:
        os.makedirs(folder, exist_ok=True)
    if samples:
        from tallywright.sources.templates import SAMPLES

        for t in SAMPLES:
            with open(os.path.join(made[3], f"{t['id']}.json"), "w", encoding="utf-8") as out:
                json.dump(t, out, indent=2)
    return made


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from tallywright.operators import documents
    from tallywright.plans import engine
    from tallywright.sources import files, templates

    config = Config.from_env()
    if args.init:
        init_directories(args.base_dir, args.with_samples)
        return OK
    spark = SparkSession.builder.appName("tallywright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    words = spark.read.parquet(args.words or args.analyze) if args.words or args.analyze else files.read_words(spark, config.input_dir, config.entitlements.check_recursive(config.recursive)).where("error is null")
    if args.analyze:
        found = engine.analyze(words, pages=documents.first_pages(words))
        for name, df in found.items():
            print(name)
            df.show(20, False)
        if args.save_template:
            name = os.path.splitext(os.path.basename(args.save_template))[0]
            engine.save_template(engine.synthesise_template(found, name), args.save_template)
        return OK
    chosen = templates.load_folders([args.templates]) if args.templates else None
    print(json.dumps(engine.Engine(spark, config).run(words, templates=chosen), default=str, indent=2))
    return OK


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallywright")
    parser.add_argument("--init", action="store_true")
    parser.add_argument("--base-dir", default=".")
    parser.add_argument("--with-samples", action="store_true")
    parser.add_argument("--words", help="Parquet of positioned words; else PDFs of INPUT_DIR are decoded")
    parser.add_argument("--templates", help="folder of template files; each document is read by the one that fits it")
    parser.add_argument("--analyze", help="Parquet of positioned words to analyse")
    parser.add_argument("--save-template", help="with --analyze: where the template that follows from the analysis goes")
    parser.add_argument("--version", action="version", version="tallywright 0.1")
    args = parser.parse_args(argv)
    try:
        return run(args)
    except ConfigurationError as e:
        log.error("%s", e)
        return BAD_CONFIG
    except EntitlementError as e:
        log.error("%s", e)
        return NOT_ENTITLED
    except FileNotFoundError as e:
        log.error("%s", e)
        return NOT_FOUND
    except PermissionError as e:
        log.error("%s", e)
        return NO_PERMISSION
    except KeyboardInterrupt:
        return INTERRUPTED
    except (StatementError, OSError, ValueError) as e:
        log.error("%s", e)
        return OTHER


if __name__ == "__main__":
    sys.exit(main())
