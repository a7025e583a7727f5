"""fathomgrid.functions"""
