"""Operators for training data: linkage without keys, text repair, packing, mixing and sentence units."""
