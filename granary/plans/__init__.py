"""From text to DataFrames: tokens, parser, statement nodes, and their lowering."""
