"""python -m tactus STEMS_FOLDER OUT_FOLDER: analyse <folder>/<track>/<stem>.wav and write one JSON row a track."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tactus.operators import analyze, score, signal, stems
from tactus.session import durable, exists, get_spark
from tactus.sources import audio, sinks, weights


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tactus", description=__doc__)
    parser.add_argument("stems", help="folder of track folders with bass, drums, other and vocals as WAV")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--overwrite", default="", help="stages to do again: a comma-separated list, or all")
    parser.add_argument("--weights", nargs="+", help="weight files (.safetensors or .npz), one for each member of the ensemble")
    parser.add_argument("--model", help="name of a network, or of an ensemble (ending in -all), whose files are in --weights-folder")
    parser.add_argument("--weights-folder", default=".", help="folder or address of the files of --model")
    parser.add_argument("--seeds", type=int, nargs="+", default=[0], help="random members where no weights are given, to try things out")
    parser.add_argument("--depth", type=int, default=11, help="blocks of the network")
    parser.add_argument("--threshold", type=float, default=0.24, help="least activation of a beat")
    parser.add_argument("--master", default="local[*]")
    args = parser.parse_args(argv)
    again = "json" in stems.with_downstream(stems.overwrite_stages(args.overwrite or None))
    spark = get_spark(args.master)
    chunks = audio.stem_chunks(spark, args.stems)
    if exists(spark, args.out) and not again:
        done = durable(audio.results(spark, args.out).selectExpr("path as track_id").distinct(), "done")
        chunks = stems.todo(chunks, done, "track_id")
    shape = score.Shape(depth=args.depth)
    files = args.weights or (weights.resolve_ensemble(args.model, args.weights_folder) if args.model else [])
    given = [weights.read_weights(p) for p in files] if files else [score.seeded(s, shape) for s in args.seeds]
    spectrogram = signal.chunk_spectrogram(chunks, ["track_id", "stem"]).withColumn("frame", F.col("frame").cast("int"))
    results = analyze.analyze_spectrogram(spectrogram, [score.Network(w, shape) for w in given], args.threshold)
    sinks.save_results(results, args.out)


if __name__ == "__main__":
    main()
