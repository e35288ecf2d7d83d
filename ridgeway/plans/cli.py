"""Run a tool from the command line: python -m ridgeway.plans.cli TOOL -i '{"in_line": …, "out": …}' [-v true].

The JSON names the dataset folders of the tool's layers (in_line, in_raster, in_footprint; a layer name may follow as
in_layer, raster_layer, footprint_layer), the dataset to write (out) and any parameter of the tool. Numbers and
booleans may be strings. Parallelism is the session's; there is no process count.
"""

from __future__ import annotations

import argparse
import json
import logging
import time

from ridgeway.plans import tools
from ridgeway.session import get_spark, ship
from ridgeway.sources import layers

_LAYER = {"in_line": ("in_layer", "lines"), "in_raster": ("raster_layer", "cells"), "in_footprint": ("footprint_layer", "footprint")}
log = logging.getLogger("ridgeway")


def main(argv: list[str] | None = None) -> list[str]:
    """The names of the layers written."""
    parser = argparse.ArgumentParser(prog="ridgeway")
    parser.add_argument("tool", choices=sorted(tools.TOOLS))
    parser.add_argument("-i", "--input", required=True, help="JSON with layers and parameters")
    parser.add_argument("-v", "--verbose", default="false")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose.lower() == "true" else logging.WARNING, format="%(asctime)s %(levelname)s %(message)s")
    given, inputs = json.loads(args.input), {}
    spark, began = get_spark(), time.time()
    ship(spark)
    out = given.pop("out")
    for p in tools.TOOLS[args.tool].parameters:
        if p.kind in ("vector", "raster"):
            name, default = _LAYER[p.name]
            inputs[p.name] = spark.read.parquet(f"{given.pop(p.name)}/{given.pop(name, default)}")
    layers.same_srid(*inputs.values())
    made = tools.TOOLS[args.tool].run(**inputs, **tools.checked(args.tool, given))
    layers.write_layers(made, out)
    log.info("%s wrote %s in %.1f s", args.tool, ", ".join(made), time.time() - began)
    return sorted(made)


if __name__ == "__main__":
    main()
