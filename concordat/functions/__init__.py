"""concordat.functions"""
