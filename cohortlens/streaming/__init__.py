"""An extension: the batch operator that adds new rows only, fed by a stream."""
