"""Sequential kernels on bounded inputs, in plain Python and numpy."""
