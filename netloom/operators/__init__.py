"""DataFrame operators on coordinate tables ``nz(i, j, re[, im][, part][, is_dummy])``."""
