"""DataFrame operators: ordinal numbering, speakers, quality, split, batches."""
