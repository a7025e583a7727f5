"""fathomgrid.operators"""
