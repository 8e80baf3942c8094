"""Mega pixels per second of strip operators on generated images: python tools/throughput.py [cpus]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from fotolake.operators.raster import strips as R  # noqa: E402
from fotolake.session import build_session  # noqa: E402


def main():
    cpus = int(sys.argv[1]) if len(sys.argv) > 1 else 8
    spark = build_session("throughput", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    side, images = 2048, 32

    def made(batches):
        for b in batches:
            out = R._Out(pa.int64())
            for i in b.column(0).to_pylist():
                a = np.random.default_rng(i).integers(0, 256, (side, side, 4), np.uint8)
                for k, y0 in enumerate(range(0, side, R.lines_of(side))):
                    yield from out.add(i, k, y0, a[y0:y0 + R.lines_of(side)], side)
            yield from out.flush()

    ids = spark.range(images).withColumnRenamed("id", "image_id").repartition(cpus * 2)
    folder = f"/tmp/strips-{time.time_ns()}"
    ids.mapInArrow(made, R._schema(ids)).write.parquet(folder)
    src = spark.read.parquet(folder)
    ops = {"invert": lambda d: R.chain(d, R.invert()), "chain of four": lambda d: R.chain(d, R.invert(), R.brightness(20), R.posterize(3), R.desaturate(50)),
           "median 3": R.median, "minimum 3": R.minimum, "blur 5 x 5": lambda d: R.effect(d, "blur"), "rotate_90": lambda d: R.transpose(d, "ROTATE_90")}
    for name, op in ops.items():
        took = []
        for _ in range(2):
            t = time.perf_counter()
            op(src).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        print(f"{name}: {images * side * side / 1e6 / min(took):.1f} Mpx/s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
