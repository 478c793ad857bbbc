"""The public functions in one place."""

from planarix.functions.binning import classify
from planarix.functions.diversity import gini_index, shannon_index, simpson_index, theil_between_group, theil_index, theil_within_group
from planarix.functions.lines import average_turning_angle, tortuosity
from planarix.operators.cluster import cluster_feats, cluster_tendency, density_clustering, dists_to_tissue, hulls, std_distance
from planarix.operators.graph import fit_delaunay, fit_distband, fit_gabriel, fit_graph, fit_knn, fit_rel_nhood, fit_voronoi, get_connected_components, link_class, w_subset, weights2gdf
from planarix.operators.grid import get_sub_grids, grid_aggregate, h3_grid, hex_grid, quadbin_grid, rect_grid
from planarix.operators.nhood import local_character, local_distances, local_diversity, local_type_counts, local_vals, nhood, reduce
from planarix.operators.objects import col_norm, gdf_apply, get_objs, interface_members, is_categorical, set_uid
from planarix.operators.overlay import buffer, dissolve, get_interfaces, medial_lines, merge_instances, merge_tissues, overlay, sliding_perpendicular_lines
from planarix.operators.pixel import chromatin_feats, collagen_fibers, cooccurrence, fiber_feats, grayscale_feats, intensity_feats, rgb_intensity_feats, stromal_intensity_feats, textural_feats
from planarix.operators.rasterise import gdf2inst, gdf2sem, inst2gdf, iterate, sem2gdf, tile_features
from planarix.operators.segmetrics import class_metrics, confusion, panoptic_quality
from planarix.operators.shape import line_metric, shape_metric, simplify, smooth
from planarix.operators.stats import global_autocorr, lisa_clustering, local_autocorr, moran_hot_cold_spots, poisson, ripley_g, ripley_k, ripley_l, ripley_test
from planarix.sources.vector import read_geojson, read_vector, write_vector

__all__ = [n for n in dir() if not n.startswith("_")]
