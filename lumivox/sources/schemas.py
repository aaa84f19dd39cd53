"""Canonical schemas."""

SCAN = "scan_id string, nx int, ny int, nz int, n_vol int, affine array<array<double>>, bvec_frame string, big_delta double, small_delta double, delta_source string, b0_threshold double"
GRADIENT = "scan_id string, vol int, bval double, gx double, gy double, gz double"
VOXEL = "scan_id string, x int, y int, z int, in_mask boolean, signal array<float>"
RESPONSE = "scan_id string, tissue string, row int, b double, coeffs array<double>"
